"""Plain versions of the operators, for small fixtures."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    places = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(places), failed


def jaccard(rows):
    """{doc_id: (n_shingles, component_id, n_links)}"""
    sets = {}
    for d, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets[d] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    parent, links = {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


def contamination(text, items, size=13):
    """(n_words, n_hit, item ids)"""
    cut = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", ascii_lower(t or ""))
    words, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            window = w[i : i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def linked(a, b):
    """Whether two lines of words are of one template: place by place, without keys."""
    n = len(a)
    if n != len(b) or a[:3] != b[:3] or n < 4:
        return a == b
    parts = min(8, n - 3)
    part = [max(i for i in range(parts) if 3 + (n - 3) * i // parts <= p) if p >= 3 else -1 for p in range(n)]
    size = Counter(part)
    differ = {part[p] for p in range(n) if a[p] != b[p]}
    fixed = lambda s: sum(w != "<*>" and not re.search("[0-9]", w) for p, w in enumerate(a) if part[p] not in s)
    sets = [{i, j} for i in range(parts) for j in range(parts)]
    fits = lambda s: sum(size[i] for i in s) <= 0.25 * n and differ <= s and fixed(s) >= max(5, n / 2)
    # A single part counts only where it goes with no other.
    return a == b or any(fits(s) and (len(s) == 2 or not any(len(t) == 2 and s < t and sum(size[i] for i in t) <= 0.25 * n for t in sets)) for s in sets)


def lines(rows, least_tokens, least_docs=3):
    """{(doc_id, text): text without recurring lines}, from all pairs of lines."""

    def mask(x):
        w = x.split()
        made = ["<*>" if re.search("[0-9]", t) else t for t in w]
        return " ".join(w if 2 * made.count("<*>") > len(made) else made)

    count, every = Counter(), []
    for d, t in rows:
        for i, x in enumerate(t.split("\n") if t is not None else []):
            y = mask(x)
            if y and len(y.split(" ")) >= least_tokens:
                every.append((d, t, i, y))
                count[y] += 1
    leaves = defaultdict(list)
    for y in sorted(count):
        leaves[(len(y.split(" ")), tuple(y.split(" ")[:3]))].append(y)
    name = {y: y for y in count}

    def top(y):
        while name[y] != y:
            y = name[y]
        return y

    for ys in leaves.values():
        for i, x in enumerate(ys):
            for y in ys[:i]:
                if linked(x.split(" "), y.split(" ")):
                    a, b = sorted((top(x), top(y)))
                    name[b] = a
    name = {y: top(y) for y in name}
    docs = defaultdict(set)
    for d, _, _, y in every:
        docs[name[y]].add(d)
    gone = defaultdict(set)
    for d, t, i, y in every:
        of = docs[name[y]]
        least = min(2, least_docs) if len(y.split(" ")) >= 20 else least_docs
        if len(of) >= least and d != min((x for x in of if x is not None), default=None):
            gone[d, t].add(i)
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]) for d, t in rows}


def ftrl(docs, labels, epochs, alpha, beta, l1, least_docs):
    """Follow the regularised leader, one coordinate at a time: (bias, {feature: weight other than 0})."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    start = math.log(share / (1 - share))
    count = Counter(f for d in docs for f in d)
    z, n = defaultdict(float), defaultdict(float)
    z["bias"] = -start * beta / alpha

    def weight(f):
        bound = 0 if f == "bias" else l1
        return 0.0 if abs(z[f]) <= bound else -(z[f] - math.copysign(bound, z[f])) / ((beta + math.sqrt(n[f])) / alpha)

    for _ in range(epochs):
        for d, y in zip(docs, labels):
            used = ["bias", *(f for f in d if count[f] >= least_docs)]
            w = {f: weight(f) for f in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in used:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return weight("bias"), {f: weight(f) for f in list(z) if f != "bias" and weight(f)}


def empirical_bayes(rows, most_shift):
    """rows: (host, path, evidence). Host and path posteriors and the score of each."""
    p = [1 / (1 + math.exp(-e)) for _, _, e in rows]
    mean = sum(p) / len(p)
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, a, _), x in zip(rows, p):
        hosts[h].append(x)
        paths[h, a].append(x)
    of = lambda xs: sum(xs) / len(xs)
    n, size = len(p), {k: len(xs) for k, xs in paths.items()}
    noise = sum((x - of(xs)) ** 2 for xs in paths.values() for x in xs) / (n - len(paths))
    shares = {h: sum((size[k] / len(xs)) ** 2 for k in paths if k[0] == h) for h, xs in hosts.items()}
    # What a unit of variance of paths, or of hosts, adds to the two sums of squares.
    per_path = sum(len(xs) * (1 - shares[h]) for h, xs in hosts.items())
    path_in_host = sum(len(xs) * shares[h] for h, xs in hosts.items()) - sum(c * c for c in size.values()) / n
    per_host = n - sum(len(xs) ** 2 for xs in hosts.values()) / n
    a = max(0, sum(len(xs) * (of(xs) - of(hosts[k[0]])) ** 2 for k, xs in paths.items()) - (len(paths) - len(hosts)) * noise) / per_path
    b = max(0, sum(len(xs) * (of(xs) - mean) ** 2 for xs in hosts.values()) - (len(hosts) - 1) * noise - a * path_in_host) / per_host
    by_host = {h: mean + (b / (b + a * shares[h] + noise / len(xs)) * (of(xs) - mean) if b else 0) for h, xs in hosts.items()}
    by_path = {k: by_host[k[0]] + (a / (a + noise / len(xs)) * (of(xs) - by_host[k[0]]) if a else 0) for k, xs in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    out = []
    for h, a, e in rows:
        shift = odds(by_path[h, a]) - odds(mean)
        shift = shift if most_shift is None else max(-most_shift, min(most_shift, shift))
        out.append((by_host[h], by_path[h, a], 1 / (1 + math.exp(-e - shift))))
    return out
