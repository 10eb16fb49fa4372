"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(fps):
    """Least index reachable over links of 3 bits, for each of fps."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def removed(docs, window=13):
    """(words, flags) for each of docs (doc_id, text): a word goes if a window over it starts in a smaller document."""
    first, own = {}, []
    for doc_id, text in docs:
        w = words(text)
        own.append((doc_id, w, [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]))
        for g in own[-1][2]:
            if doc_id is not None:
                first[g] = min(first.get(g, doc_id), doc_id)
    out = []
    for doc_id, w, grams in own:
        gone = [False] * len(w)
        for i, g in enumerate(grams):
            if doc_id is not None and first[g] < doc_id:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def base_rules(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def generalised_jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def _split(name, counts, total):
    """The cheapest split of a name by trying all last words, with memory; ties go to the longest last word."""
    best = {"": (0.0, [])}
    for end in range(1, len(name) + 1):
        found = []
        for size in range(1, min(20, end) + 1):
            word, before = name[end - size : end], best[name[: end - size]]
            cost = -math.log(counts[word] / total) if counts[word] else -math.log(10 / total / 10**size)
            found.append((before[0] + cost, -size, [*before[1], word]))
        least = min(found)
        best[name[:end]] = (least[0], least[2])
    return best[name][1]


def url_verdicts(pages, texts, rules, seeds, listed, listed_count=1000, listed_counts=20, smoothing=4.0):
    """{page_id: (host, path, rule, verdict)} by Bayes over dictionaries; pages: (page_id, url), rules: (host, path, verdict)."""
    counts = Counter()
    for text in texts:
        trimmed = (regex.sub(r"^[^\p{L}]+|[^\p{L}]+$", "", w) for w in words((text or "").lower()))
        counts.update(w for w in trimmed if 0 < len(w) <= 20)
    for w in listed:
        counts[w] += listed_count
    total = sum(counts.values())
    rows = {}
    for page_id, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1])) if fits else None
        shape = regex.findall(r"[\p{L}\p{N}#]+", re.sub("[0-9]+", "#", path.lower()))
        rows[page_id] = (host, path, rule, " ".join(shape))
    memory = {}

    def tokens(names):
        for name in names:
            if name not in memory:
                memory[name] = _split(name, counts, total)
        return Counter(t for name in names for t in memory[name])

    hosts = {h: tokens(regex.findall(r"[\p{L}\p{N}]+", h)) for h, _, _, _ in rows.values()}
    shapes = {s: tokens(s.split()) for _, _, _, s in rows.values()}
    taught = {(h, s) for h, _, rule, s in rows.values() if not rule or rule[2] != "block"}
    has_seed = lambda own: any(t in seeds for t in own)
    bad = {}
    for host in {h for h, _ in taught}:
        own = [has_seed(shapes[s]) for h, s in taught if h == host]
        bad[host] = has_seed(hosts[host]) or sum(own) * 2 >= len(own)
    classes = [{(h, bad[h]) for h in bad}, {(s, bad[h] or has_seed(shapes[s])) for h, s in taught}]
    ratios = []
    for owners, members in ((hosts, classes[0]), (shapes, classes[1])):
        by = {True: Counter(), False: Counter()}
        for owner, is_bad in members:
            by[is_bad].update(owners[owner])
        n_bad, n_good = sum(by[True].values()), sum(by[False].values())
        share = (n_bad + 1) / (n_bad + n_good + 2)
        ratios.append(
            {
                t: math.log((by[True][t] + listed_counts * (t in seeds) + smoothing * share) / (by[False][t] + smoothing * (1 - share))) - math.log(share / (1 - share))
                for t in {*by[True], *by[False], *seeds}
            }
        )
    prior = min(0.0, math.log((sum(bad.values()) + 1) / (len(bad) - sum(bad.values()) + 1)))
    out = {}
    for page_id, (host, path, rule, shape) in rows.items():
        score = prior + sum(n * ratios[0].get(t, 0) for t, n in hosts[host].items()) + sum(n * ratios[1].get(t, 0) for t, n in shapes[shape].items())
        blocked = round(score, 6) > 0 and bool(hosts[host] or shapes[shape])
        out[page_id] = (host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if blocked else "allow")
    return out
