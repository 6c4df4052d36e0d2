"""Toxicity by weak supervision.

1. Voters.  Given ones: insults of four languages (a lexicon), patterns (an insult after "you are", shouting, runs of exclamation marks,
   masked letters), and for the clean side politeness, license lines, links, and texts of some length that no other voter has
   marked.  Mined ones: words and word prefixes (4 to 8 letters) that mark the toxic class among at most ``max_labelled`` labelled
   training rows (chosen by a hash of the id), counted by Spark and kept by a binomial test corrected for the
   number of candidates.  A voter votes for its side or abstains; abstaining says nothing.
2. Label model: class balance, each voter's rates P(vote | class) and the correlations of voters within either class, by
   EM.  Every training row takes part: Spark counts the distinct vote patterns once, each round is one pass over that table, and only sums
   per voter (and once per pair of voters) come back.  Labelled rows keep their labels; votes of correlated voters
   (a prefix and the words it covers) share one vote's weight.
3. A linear classifier on the voters' counts learns the posterior labels of the labelled sample, where the given label is one more vote of
   accuracy ``label_accuracy``, and scores every text.

The sample, the mined voters (``max_voters``) and so the model are bounded by their parameters; every text is
scored whole, in one pass.

Defined results: null and empty texts get the classifier's score for no votes; without toxic or
without clean training labels there is no model and every score is the observed rate (0 without labels);
null labels and labels of unknown ids are ignored; an id labelled twice counts as toxic if any label says so;
repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import byte_planes, from_planes, packed, releasing, unpacked

PREFIXES = (4, 5, 6, 7, 8)

# fixed values: general insults in English, German, French and Spanish, and words of politeness
INSULTS = ("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool jerk creep filth vermin "
           "imbecile cretin bastard asshole bitch shit fuck "
           "dumm dummkopf trottel versager abschaum erbärmlich wertlos widerlich ekelhaft arschloch "
           "imbécile crétin stupide débile minable ordure pathétique dégoûtant connard salaud "
           "idiota imbécil estúpido tonto basura escoria perdedor patético inútil asqueroso payaso").split()
POLITE = "please thanks thank bitte danke merci gracias sorry".split()
#: words from which a text without any other vote counts as quiet
QUIET_WORDS = 40
#: rounds of EM before and after the correlations are known
ROUNDS = 4


def patterns() -> list[tuple[str, str | None, str]]:
    """(name, text that must occur, pattern) of the given pattern voters; those from ``license`` on vote clean."""
    some = "|".join(INSULTS)
    return [
        ("#insulted", "you", rf"\byou(?:'re| are) (?:an? |so |such an? )?(?:{some})\b"),
        ("#shout", None, r"[A-ZÀ-Þ]{4,} [A-ZÀ-Þ]{4,} [A-ZÀ-Þ]{4,}"),
        ("#bang", "!!", ""),
        ("#masked", "**", r"[A-Za-z]\*\*+[A-Za-z]"),
        ("#license", "icense", r"(?i)licensed? under"),
        ("#link", "://", ""),
    ]


CLEAN = frozenset(["#license", "#link", "#polite", "#quiet"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def _share(col, n: int, most: int):
    """A hash filter that keeps about ``most`` of ``n`` rows, all when they are fewer."""
    return F.pmod(F.xxhash64(col, F.lit(11)), F.lit(1 << 24)) < int(min(1.0, most / max(n, 1)) * (1 << 24))


def features(word: str) -> list[str]:
    """A word's candidate voters: itself and its proper prefixes, marked by ``*``."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def _words():
    import re
    return re.compile(r"[^\W\d_]+").findall


def _candidates():
    def run(batches):
        from collections import Counter
        find = _words()
        for pdf in batches:
            both = (Counter(), Counter())
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                seen = set()
                for w in set(find(text.lower())):
                    seen.update(features(w))
                both[int(toxic)].update(seen)
            keys = both[0].keys() | both[1].keys()
            yield pd.DataFrame([(k, both[1][k], both[0][k]) for k in keys], columns=["feature", "a", "b"])

    return run, "feature string, a long, b long"


def mine_voters(labelled: DataFrame, max_voters: int = 400, precision: float = 0.6, least: int = 4) -> tuple[list[str], float]:
    """Voters of a bounded labelled sample (text, toxic 0/1) and its toxic rate."""
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    rate = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not n1 or not n0:
        return [], rate
    run, out = _candidates()
    counts = materialize(labelled.mapInPandas(releasing(run), out).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
                         .where(F.col("a") + F.col("b") >= least))
    tested = counts.count()
    p = F.col("a") / (F.col("a") + F.col("b"))
    # log-likelihood ratio of the observed precision against the base rate
    gain = F.col("a") * F.log(p / rate) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    best = (counts.where((F.col("a") >= least) & (p >= precision)).withColumn("gain", gain)
            .where(F.col("gain") >= float(np.log(max(tested, 1)) + 3)).orderBy(F.desc("gain"), "feature").limit(max_voters))
    return sorted(r["feature"] for r in best.collect()), rate


class Votes:
    """Counts of voters in texts; ``names`` are the given voters, then the mined ones."""

    def __init__(self, mined: list[str]):
        given = [f"!{w}" for w in INSULTS]
        self.patterns = [(name, need, re.compile(p).search if p else None) for name, need, p in patterns()]
        self.names = [*given, *(n for n, *_ in self.patterns), "#polite", "#quiet", *mined]
        self.at = {v: i for i, v in enumerate(self.names)}
        self.find = _words()
        self.polite = frozenset(POLITE)
        self.seen: dict = {}

    def voters_of(self, word: str) -> tuple[int, ...]:
        out = [self.at[f] for f in features(word) if f in self.at]
        if "!" + word in self.at:
            out.append(self.at["!" + word])
        if word in self.polite:
            out.append(self.at["#polite"])
        return tuple(out)

    def of(self, text) -> dict[int, int]:
        from collections import Counter
        out: dict[int, int] = {}
        if not text:
            return out
        words = Counter(self.find(text.lower()))
        for w, n in words.items():
            hit = self.seen.get(w)
            if hit is None:
                if len(self.seen) > 200_000:
                    self.seen = {}
                hit = self.seen[w] = self.voters_of(w)
            for i in hit:
                out[i] = out.get(i, 0) + n
        for name, need, search in self.patterns:
            if (need is None or need in text) and (search is None or search(text)):
                out[self.at[name]] = 1
        if not out and sum(words.values()) >= QUIET_WORDS:
            out[self.at["#quiet"]] = 1
        return out


class LabelModel:
    """Rates of each voter in the toxic (``a``) and the clean class (``b``), the balance, and each vote's weight."""

    def __init__(self, voters: int):
        self.a = self.b = np.full(voters, 0.5)
        # that of the labelled rows: rows without votes, which have it as their posterior, must not move it
        self.balance: float | None = None
        self.weight = np.ones(voters)

    def posterior(self, row: np.ndarray, voter: np.ndarray, rows: int) -> np.ndarray:
        """P(toxic) of rows from their (row, voter) votes; voters that abstain say nothing."""
        each = self.weight * np.log(self.a / self.b)
        balance = self.balance or 0.5
        z = np.log(balance / (1 - balance)) + np.bincount(row, weights=each[voter], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def update(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> None:
        """New rates from the classes' (expected) numbers of rows and of votes."""
        total, votes = max(n_toxic + n_clean, 1e-9), toxic + clean
        if self.balance is None:
            self.balance = float(np.clip(n_toxic / total, 1e-4, 1 - 1e-4))
        # a voter without votes is drawn to its mean rate, so it says nothing
        mean = (votes + 0.5) / (total + 1)
        self.a = (toxic + 2 * mean) / (n_toxic + 2)
        self.b = (clean + 2 * mean) / (n_clean + 2)

    def correlate(self, both_toxic: np.ndarray, both_clean: np.ndarray, n_toxic: float, n_clean: float) -> None:
        """Weights 1 / (1 + a vote's positive correlations with others in the class where they are larger), from the numbers of
        common votes."""
        share = np.zeros_like(both_toxic)
        for both, rate, n in ((both_toxic, self.a, n_toxic), (both_clean, self.b, n_clean)):
            sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
            corr = (both / max(n, 1e-9) - np.outer(rate, rate)) / np.outer(sd, sd)
            share = np.maximum(share, np.clip(corr, 0, 1))
        np.fill_diagonal(share, 0)
        self.weight = 1 / (1 + np.where(share > 0.1, share, 0).sum(axis=1))


_PATTERN = "label int, fired array<int>, n long"


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, voter) of an array column."""
    lens = np.diff(col.offsets.to_numpy())
    return np.repeat(np.arange(len(col)), lens), col.flatten().to_numpy(zero_copy_only=False)


def _expect(model: LabelModel, b: pa.RecordBatch) -> tuple:
    """(row, voter, P(toxic) x count, P(clean) x count) of a batch of vote patterns."""
    row, voter = _flat(b.column(1))
    label, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
    p = np.where(label >= 0, label, model.posterior(row, voter, b.num_rows))
    return row, voter, p * n, (1 - p) * n


def _round(model: LabelModel, table: DataFrame) -> None:
    """One round of EM over all vote patterns: tasks send sums per voter."""
    size = len(model.a)

    def run(batches):
        toxic, clean, total = np.zeros(size), np.zeros(size), np.zeros(2)
        for b in batches:
            row, voter, t, c = _expect(model, b)
            toxic += np.bincount(voter, weights=t[row], minlength=size)
            clean += np.bincount(voter, weights=c[row], minlength=size)
            total += t.sum(), c.sum()
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (toxic, clean, total)], names=["t", "c", "n"])

    parts = table.mapInArrow(run, "t array<double>, c array<double>, n array<double>").collect()
    toxic, clean, total = (np.sum([r[k] for r in parts], axis=0) for k in ("t", "c", "n"))
    model.update(toxic, clean, total[0], total[1])


def _correlations(model: LabelModel, table: DataFrame, groups: int = 16) -> None:
    """Common votes of voter pairs in either class: a compressed matrix a task, summed by Spark in ``groups`` shares and then here."""
    size = len(model.a)
    shape, names, kind = (2, size * size + 1), ["g", "sums"], "g int, sums binary"

    def blob(g, sums):
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([packed(byte_planes(sums.ravel().view(np.uint64)))], pa.binary())], names=names)

    def matrix(raw):
        return from_planes(unpacked(raw, np.uint8), np.uint64).view(np.float64).reshape(shape)

    def run(batches):
        from pyspark import TaskContext
        both, total = np.zeros((2, size, size)), np.zeros((2, 1))
        for b in batches:
            row, voter, *weights = _expect(model, b)
            for a in range(0, b.num_rows, 2000):
                here = (row >= a) & (row < a + 2000)
                x = np.zeros((min(2000, b.num_rows - a), size), np.float32)
                x[row[here] - a, voter[here]] = 1
                for k, w in enumerate(weights):
                    both[k] += (x * w[a: a + 2000, None].astype(np.float32)).T @ x
            total += [[w.sum()] for w in weights]
        yield blob(TaskContext.get().partitionId() % groups, np.hstack([both.reshape(2, -1), total]))

    def add(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([blob(t["g"][0].as_py(), sum(matrix(x) for x in t["sums"].to_pylist()))])

    got = table.mapInArrow(run, kind).groupBy("g").applyInArrow(add, kind).collect()
    sums = sum(matrix(r["sums"]) for r in got)
    both, total = sums[:, :-1].reshape(2, size, size), sums[:, -1]
    model.correlate(both[0], both[1], total[0], total[1])


def fit_labels(table: DataFrame, voters: int, rounds: int = ROUNDS) -> LabelModel:
    """The label model of vote patterns (label or -1, voters that fired, rows)."""
    model = LabelModel(voters)
    # the first rates come from the labelled rows alone
    _round(model, table.where("label >= 0"))
    for _ in range(rounds):
        _round(model, table)
    _correlations(model, table)
    for _ in range(rounds):
        _round(model, table)
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps (bias last, not penalised)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def design(counts: list[dict[int, int]], n: int, clean: np.ndarray) -> np.ndarray:
    """Classifier features: log count of each voter, and of all toxic votes alike."""
    x = np.zeros((len(counts), n + 1))
    for r, c in enumerate(counts):
        for i, k in c.items():
            x[r, i] = np.log1p(k)
        x[r, n] = np.log1p(sum(not clean[i] for i in c))
    return x


def _clean(names: list[str]) -> np.ndarray:
    return np.array([n in CLEAN for n in names])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000, max_voters: int = 400, label_accuracy: float = 0.97) -> dict:
    """The bounded model from the training part of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    labels = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").alias("_l")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    labels = labels.withColumn("chosen", _share(F.col("_l"), labels.count(), max_labelled))
    rows = docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text")
    sample = labels.where("chosen").select("_l", "toxic")
    # about max_labelled narrow rows: a bounded broadcast
    sample = materialize(rows.join(F.broadcast(sample), rows["doc_id"] == sample["_l"]).select("text", "toxic"))
    mined, rate = mine_voters(sample, max_voters)
    if not 0 < rate < 1:
        return {"mined": [], "weights": [30.0 if rate else -30.0]}
    names = Votes(mined).names

    def vote(batches):
        v = Votes(mined)
        for b in batches:
            got = [v.of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(c) for c in got], pa.list_(pa.int32())),
                                              pa.array([[c[i] for i in sorted(c)] for c in got], pa.list_(pa.int32()))], names=["label", "fired", "k"])

    votes = "label int, fired array<int>, k array<int>"
    # votes are made where the texts are; the labels of all training rows meet the narrow patterns
    fired = rows.select("text", F.col("doc_id").alias("label")).mapInArrow(releasing(vote), "label long, fired array<int>, k array<int>")
    table = (fired.join(labels, fired["label"] == labels["_l"], "left").select(F.coalesce("toxic", F.lit(-1)).alias("label"), "fired")
             .groupBy("label", "fired").agg(F.count(F.lit(1)).alias("n")))
    model = fit_labels(materialize(table), len(names))
    # at most max_labelled rows of voter counts
    got = sample.select("text", F.col("toxic").alias("label")).mapInArrow(vote, votes).collect()
    counts = [dict(zip(r["fired"], r["k"])) for r in got]
    row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    p = model.posterior(row, np.array([i for c in counts for i in c], np.int64), len(counts))
    given = np.where(np.array([r["label"] for r in got]) > 0, label_accuracy, 1 - label_accuracy)
    y = p * given / (p * given + (1 - p) * (1 - given))
    return {"mined": mined, "weights": fit_linear(design(counts, len(names), _clean(names)), y).tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        w = np.array(shared.value["weights"])
        v = Votes(shared.value["mined"])
        clean = _clean(v.names)
        for b in batches:
            if len(w) > 1:
                z = design([v.of(t.as_py()) for t in b.column(2)], len(v.names), clean) @ w[:-1] + w[-1]
            else:
                z = np.full(b.num_rows, w[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.3).astype(np.int32))], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
            .mapInArrow(releasing(run), "doc_id long, held_out boolean, score double, predicted int"))


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    return score(docs, train(docs, labels, **params))
