"""Plain version of the repair of conversations: every state keeps its cheapest, least sequence of edits."""

import hashlib
import re
import zlib
from collections import defaultdict

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    """conv_id: its rows after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        found = out[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            found += [(turn, role, text)] * (2 if kind == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of one conversation's rows."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", [])}

    def better(found, state, cost, letters, out):
        if state not in found or (cost, letters) < found[state][:2]:
            found[state] = (cost, letters, out)
            return True

    def put_in(found):
        again = True
        while again:
            again = False
            for state, (cost, letters, out) in list(found.items()):
                for r in "ua":
                    if r in NEXT[state] and better(found, NEXT[state][r], cost + 2, letters + "I", [*out, f"{NAMES[r]}:"]):
                        again = True

    for (_, role, text), fault in zip(rows, faults):
        put_in(best)
        after = {}
        for state, (cost, letters, out) in best.items():
            better(after, state, cost + 3, letters + "D", out)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in NEXT[state]:
                    better(after, NEXT[state][role[:1]], cost + more, letters + "K", [*out, f"{role}:{text}"])
                for r in "ua":
                    if r in NEXT[state]:
                        better(after, NEXT[state][r], cost + 2 + more, letters + "R", [*out, f"{NAMES[r]}:{text}"])
        best = after
    put_in(best)
    cost, letters, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], bad, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())
