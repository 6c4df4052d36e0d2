"""Token ids of texts with a tokenizer file of the ``tokenizers`` library (``word_bpe_49k``).

That tokenizer drops white space and never joins letters across it, so a text's ids are the
concatenation of its space-separated pieces' ids.  A batch is cut into pieces, each distinct piece is
encoded once per worker (a bounded cache) and ids are gathered.  A lower-case ASCII letter or
digit followed by one final comma or full stop is split there, as the tokenizer itself does.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from .arrays import lower_ascii, prefix_sums, ranges, span_hash, word_spans, worker_cache

#: pieces kept per worker; about 60 bytes each
CACHE_PIECES = 1_500_000


#: pieces encoded as one line
LINE = 1000
WORD_END = "</w>"


def check_kind(tok) -> None:
    """Pieces stand for themselves only if the tokenizer lower-cases, drops white space and marks word ends; ids are 16 bits."""
    def parts(component, key):
        spec = json.loads(component.__getstate__()) if component is not None else {}
        return [(x["type"], x.get("behavior")) for x in spec.get(key, [])]
    if not (type(tok.model).__name__ == "BPE" and tok.model.end_of_word_suffix == WORD_END and not tok.model.dropout
            and tok.get_vocab_size() <= 1 << 16 and tok.post_processor is None
            and {t for t, _ in parts(tok.normalizer, "normalizers")} == {"NFC", "Replace", "Lowercase"}
            and parts(tok.pre_tokenizer, "pretokenizers") == [("Split", "Removed"), ("ByteLevel", None)]):
        raise ValueError("not a tokenizer of the word_bpe kind: lower case, white space dropped, BPE with word ends")


def one_word(piece: str) -> bool:
    """Letters only, also once in lower case and composed form."""
    return piece.isalpha() and (piece.isascii() or (unicodedata.is_normalized("NFC", piece) and piece.lower().isalpha()))


def _ids(encodings) -> np.ndarray:
    return np.fromiter(chain.from_iterable(e.ids for e in encodings), np.uint16, sum(map(len, encodings)))


class PieceEncoder:
    """Distinct pieces -> ids, remembered as sorted hashes with an offset table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        check_kind(self.tok)
        self.ends_word = np.zeros(1 << 16, bool)
        for i in range(self.tok.get_vocab_size()):
            self.ends_word[i] = self.tok.id_to_token(i).endswith(WORD_END)
        # the strings of special tokens are ordinary text inside a document
        self.tok.encode_special_tokens = True
        self.reset()

    def reset(self):
        # two sorted levels, a large one and a small recent one
        self.levels = [_Level.empty(), _Level.empty()]

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per piece, ids side by side).  A piece of letters is one word, so such pieces are encoded in long
        lines, which costs less a piece, and told apart by the ids that end a word."""
        words = [i for i, p in enumerate(pieces) if one_word(p)]
        rest = sorted(set(range(len(pieces))).difference(words))
        lines = [" ".join(pieces[i] for i in words[a: a + LINE]) for a in range(0, len(words), LINE)]
        flat = np.concatenate([_ids(self.tok.encode_batch_fast(lines[a: a + 20], add_special_tokens=False))
                               for a in range(0, max(1, len(lines)), 20)])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer splits a word of letters")
        lens = np.zeros(len(pieces), np.int64)
        lens[words] = np.diff(ends, prepend=0)
        if not rest:
            return lens, flat
        out = self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)
        lens[rest] = [len(e) for e in out]
        both = np.concatenate([flat, _ids(out)])
        at = np.zeros(len(pieces), np.int64)
        at[words + rest] = np.cumsum(lens[words + rest]) - lens[words + rest]
        return lens, both[ranges(at, lens)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint16, offsets by document) of a buffer of documents."""
        n_docs = len(offsets) - 1
        low = lower_ascii(data)
        starts, ends, doc = piece_spans(low, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint16), np.zeros(n_docs + 1, np.int64)
        h = span_hash(prefix_sums(low), starts, ends)
        enc = pa.array(h).dictionary_encode()
        inv = enc.indices.to_numpy(zero_copy_only=False)
        uniq = enc.dictionary.to_numpy(zero_copy_only=False)
        first = np.empty(len(uniq), np.int64)
        first[inv[::-1]] = np.arange(len(inv) - 1, -1, -1)
        at = [lv.find(uniq) for lv in self.levels]
        miss = np.flatnonzero((at[0] < 0) & (at[1] < 0))
        lens = np.zeros(len(uniq), np.int64)
        src = np.zeros(len(uniq), np.int64)
        pools, base = [], 0
        for lv, p in zip(self.levels, at):
            f = np.flatnonzero(p >= 0)
            lens[f] = lv.offs[p[f] + 1] - lv.offs[p[f]]
            src[f] = lv.offs[p[f]] + base
            pools.append(lv.ids)
            base += len(lv.ids)
        if len(miss):
            raw = low.tobytes()
            pieces = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[miss]].tolist(), ends[first[miss]].tolist())]
            new_l, flat = self.encode_new(pieces)
            lens[miss] = new_l
            src[miss] = base + np.concatenate([[0], np.cumsum(new_l)[:-1]])
            pools.append(flat)
            big, small = self.levels
            small = small.plus(uniq[miss], new_l, flat)
            if len(small.keys) > CACHE_PIECES // 8:
                if len(big.keys) + len(small.keys) > CACHE_PIECES:
                    big = _Level.empty()
                big, small = big.plus(small.keys, small.offs[1:] - small.offs[:-1], small.ids), _Level.empty()
            self.levels = [big, small]
        pool = np.concatenate(pools)
        # distinct pieces' ids side by side, then gathered in text order
        uo = np.concatenate([[0], np.cumsum(lens)])
        flat_u = pool[ranges(src, lens)]
        out_l = lens[inv]
        ids = flat_u[ranges(uo[inv], out_l)]
        total = np.concatenate([[0], np.cumsum(out_l)])
        return ids, total[np.searchsorted(doc, np.arange(n_docs + 1))]


class _Level:
    """Sorted piece hashes with their ids."""

    def __init__(self, keys, offs, ids):
        self.keys, self.offs, self.ids = keys, offs, ids

    @staticmethod
    def empty():
        return _Level(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint16))

    def find(self, keys) -> np.ndarray:
        """Positions, -1 where absent."""
        if len(self.keys) == 0:
            return np.full(len(keys), -1, np.int64)
        p = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[p] == keys, p, -1)

    def plus(self, keys, lens, ids):
        k = np.concatenate([self.keys, keys])
        ln = np.concatenate([self.offs[1:] - self.offs[:-1], lens])
        o = np.concatenate([[0], np.cumsum(ln)[:-1]])
        i = np.concatenate([self.ids, ids])
        order = np.argsort(k)
        return _Level(k[order], np.concatenate([[0], np.cumsum(ln[order])]), i[ranges(o[order], ln[order])])


def piece_spans(low: np.ndarray, offsets: np.ndarray):
    """Space-separated pieces; a final ``,`` or ``.`` after an ASCII letter or digit is its own piece."""
    starts, ends, doc = word_spans(low, offsets)
    if len(starts) == 0:
        return starts, ends, doc
    lastc = low[ends - 1]
    prev = low[np.maximum(ends - 2, 0)]
    cut = (ends - starts >= 2) & ((lastc == 44) | (lastc == 46)) & (((prev >= 97) & (prev <= 122)) | ((prev >= 48) & (prev <= 57)))
    if not cut.any():
        return starts, ends, doc
    n = len(starts)
    at = np.arange(n) + np.concatenate([[0], np.cumsum(cut)[:-1]])
    total = n + int(cut.sum())
    s2, e2, d2 = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    s2[at], e2[at], d2[at] = starts, ends - cut, doc
    c = at[cut] + 1
    s2[c], e2[c], d2[c] = ends[cut] - 1, ends[cut], doc[cut]
    return s2, e2, d2


def encoder(path: str) -> PieceEncoder:
    return worker_cache("piece_encoder", lambda: {}).setdefault(path, None) or _make(path)


def _make(path: str) -> PieceEncoder:
    home = worker_cache("piece_encoder", lambda: {})
    home[path] = PieceEncoder(path)
    return home[path]
