"""Brute force of the conversation repair: all edit lists by Dijkstra on (cost, edits) over plain rows."""

import hashlib
import heapq
import re
import zlib

ROLES = {"u": "user", "a": "assistant"}
LAST = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """rows: (conv_id, turn, role, text) -> the same after damage; dropped rows gone."""
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = LAST.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, edits, repaired rows): uniform-cost search ordered by (cost, edits)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, edits, out
        if (i, last) in done:
            continue
        done.add((i, last))
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        heapq.heappush(heap, (cost + 5, edits + "I", i, wanted, out + (f"{ROLES[wanted]}:",)))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, last, out))
            if bad[i] in ("blank", "duplicate"):
                continue
            more = 5 if bad[i] == "truncated" else 0
            if role[:1] == wanted or (role[:1] == "s" and last == ""):
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[:1], out + (f"{role}:{text}",)))
            heapq.heappush(heap, (cost + more + 1, edits + "R", i + 1, wanted, out + (f"{ROLES[wanted]}:{text}",)))
    raise AssertionError


def repaired(rows, order):
    """One result row a conversation; ``order`` sorts rows of equal turn."""
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, order(r)))
        bad = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, edits, lines = cheapest(own, bad)
        out.append((conv, gaps, *(bad.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
