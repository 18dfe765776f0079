"""Plain versions of the corpus operators, for small fixtures."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words(fold(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(ids, linked):
    name = {i: i for i in ids}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b) and root(a) != root(b):
            name[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def jaccard(docs, n, percent):
    """doc_id -> (set size, component) of a dict of texts."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    return {i: (len(sets[i]), c) for i, c in groups(docs, linked).items()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
    return row[-1]


def line_dedup(docs, least_near=5):
    """doc_id -> kept text: a line goes if an earlier one is its copy or, from ``least_near`` words on, one word edit away."""
    lines = [(i, n, line) for i, t in sorted(docs.items()) for n, line in enumerate((t or "").split("\n"))]
    gone = set()
    for at, (i, n, line) in enumerate(lines):
        a = words(fold(line))
        for _, _, other in lines[:at]:
            b = words(fold(other))
            if a and b and (a == b or (min(len(a), len(b)) >= least_near and edits(a, b) <= 1)):
                gone.add((i, n))
                break
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in docs.items()}


def substring_dedup(docs, window):
    """doc_id -> (number of words, kept words)."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        w, gone = words(t), set()
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            seen.add(key)
        out[i] = (len(w), [x for n, x in enumerate(w) if n not in gone])
    return out


def contaminated(docs, items, percent=80, window=13):
    """Pairs (doc, item) with a window of enough equal words on one diagonal."""
    found = set()
    for (i, t), (j, item) in itertools.product(docs.items(), items.items()):
        a, b = words(fold(t)), words(fold(item))
        size = min(window, len(b))
        if size and any(100 * sum(x == y for x, y in zip(a[p : p + size], b[q : q + size])) >= percent * size for p in range(len(a) - size + 1) for q in range(len(b) - size + 1)):
            found.add((i, j))
    return found


def decided(captures, entries):
    """For each (url, time): action, rule and start of the most specific entry that holds then; entries (rule, action, time)."""
    from urllib.parse import urlsplit

    held = {}
    for rule, action, at in entries:
        if None not in (rule, action, at):
            held.setdefault(rule, {})[at] = max(action, held.get(rule, {}).get(at, ""))
    out = []
    for url, at in captures:
        best = None
        if url and at is not None and "://" in url:
            parts = urlsplit(url)
            host, segments = parts.hostname or "", [x for x in parts.path.split("/") if x]
            labels = host.split(".")
            keys = [".".join(labels[i:]) for i in range(len(labels))] + ["/".join([host, *segments[: i + 1]]) for i in range(len(segments))]
            for rule in keys:
                begun = [t for t in held.get(rule, {}) if t <= at]
                if begun and held[rule][max(begun)] in ("block", "allow"):
                    best = max(best or (), ("/" in rule, len(rule), rule, held[rule][max(begun)], max(begun)))
        out.append((best[3], best[2], best[4]) if best else ("none", None, None))
    return out


def languages(docs, labels):
    """doc_id -> language or None (no letter, or ambiguous): counts of n-grams, one log-odds table for each bit of the code,
    the nearest codeword by logistic loss. Training documents are those with a label whose crc32 is not 2 by 4."""
    import math
    import zlib
    from collections import Counter

    import regex

    from marlstone.llm import langid

    def grams(text):
        out = Counter()
        for w in regex.findall(r"\p{L}+", (text or "").lower()):
            out.update(langid.grams([w])[0].tolist())
        return out

    names = sorted({x for i, x in labels.items() if x and zlib.crc32(str(i).encode()) % 4 != 2 and docs[i] is not None})
    code = langid.codewords(len(names)).tolist()
    counts = {x: Counter() for x in names}
    for i, t in docs.items():
        if t is not None and labels[i] and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[labels[i]].update(grams(t))
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in names}
    share = lambda x, g: (counts[x][g] + 0.5) / total[x]
    bits = range(len(code[0]))
    tables, trust = [], []
    for b in bits:
        one, zero = ([x for x, row in zip(names, code) if row[b] == v] for v in (1, -1))
        p, q = ([sum(share(x, g) for x in side) / len(side) for g in range(langid.BUCKETS)] for side in (one, zero))
        tables.append([math.log(x / y) for x, y in zip(p, q)])
        trust.append(0.5 * sum((x - y) * w for x, y, w in zip(p, q, tables[-1])))
    mean = sum(trust) / len(trust)
    out = {}
    for i, t in docs.items():
        found = grams(t)
        n = sum(found.values())
        if not n:
            out[i] = None
            continue
        margins = [sum(k * tables[b][g] for g, k in found.items()) / math.sqrt(n) for b in bits]
        loss = [sum((math.log1p(math.exp(-abs(margins[b] * row[b]))) + max(0.0, -margins[b] * row[b])) * trust[b] / mean for b in bits) for row in code]
        least = min(loss)
        odds = [math.exp(least - x) for x in loss]
        out[i] = names[loss.index(least)] if max(odds) / sum(odds) >= langid.SURE else None
    return out
