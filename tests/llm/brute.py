"""Plain versions of the contracts, for small inputs."""

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def overlaps(docs, items, n=13):
    """{doc: (words, hit words, items, digest of the items, contaminated, places of the hit stretches)}"""
    windows = {}
    for item, text in items:
        w = ALNUM_WORD.findall(lower(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w = ALNUM_WORD.findall(lower(text))
        hit, ids = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    ids |= found
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        places = ",".join(f"{spans[i][0]}:{spans[next(j for j in range(i, len(w) + 1) if j not in hit) - 1][1]}" for i in sorted(hit) if i - 1 not in hit)
        out[doc] = (len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit) and 20 * len(hit) >= len(w), places)
    return out


def near(docs, k=3, percent=85):
    sets = {}
    for doc, text in docs:
        w = SPACE_WORD.findall(lower(text))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def base_secrets(text):
    """Counts and digest of the base patterns, from the contract's own words."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    found.sort(key=lambda f: (f[1], order[f[0]]))
    count = lambda k: sum(f[0] == k for f in found)
    return count("assign"), count("access"), count("hex"), sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))


def linked_vectors(rows, least=0.93):
    """rows: (vec_id, label, vector); cosines one by one."""
    import numpy as np

    ok = [(i, lab, np.array(v, np.float64)) for i, lab, v in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for label, dim in {(lab, len(v)) for _, lab, v in ok}:
        own = [(i, v / np.linalg.norm(v)) for i, lab, v in ok if (lab, len(v)) == (label, dim)]
        x = np.array([v for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            p, q = own[a][0], own[b][0]
            links[p] += 1
            links[q] += 1
            p, q = sorted((find(p), find(q)))
            root[q] = p
    return {i: (links[i], find(i), find(i) == i) for i in links}


def repeated_lines(docs, k=8, percent=80):
    """{doc: places removed}; docs in ascending order of id. All pairs of distinct lines."""
    first, sets = {}, {}
    for doc, text in docs:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip("\x20\t\n\r\x0b\x0c"):
                first.setdefault(line, (doc, pos))
    for line in first:
        u = line.encode("utf-16-le")
        sets[line] = {u[2 * i : 2 * (i + k)] for i in range(max(1, len(u) // 2 - k + 1))}
    root = {line: line for line in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = sorted(first, key=lambda x: len(sets[x]))
    for i, a in enumerate(by):
        for b in by[i + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    keep = {}
    for line, at in first.items():
        keep[find(line)] = min(keep.get(find(line), at), at)
    out = {}
    for doc, text in docs:
        out[doc] = [pos for pos, line in enumerate((text or "").split("\n") if text is not None else []) if line in first and keep[find(line)] != (doc, pos)]
    return out


def repeats(docs, n=50):
    """{doc: (words, removed, digest of the kept words)}"""
    words = {d: SPACE_WORD.findall(t or "") for d, t in docs}
    least = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - n + 1):
            least.setdefault(tuple(w[i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fused(rows, model, fusion):
    """{id: (lang, posterior)} of rows (id, text, host, suffix, declared), one by one; each row's own vote is left out of all tables."""
    import math
    from collections import Counter

    langs = [*model.languages, "und"]
    k, told = len(langs), {}
    for i, text, *_ in rows:
        n, x = model.score(text)
        x = [v * (min(1.0, fusion.evidence / n) if n else 0.0) for v in x]
        p = [math.exp(v - max(x)) for v in x]
        told[i] = n, x, [round(v / sum(p) * 1e6) / 1e6 if n else 0.0 for v in p]
    domain = lambda h: ".".join(h.split(".")[-2:])
    out = {}
    for i, _, host, suffix, declared in rows:
        n, score, _ = told[i]
        if not n:
            out[i] = ("und", 0.0)
            continue
        votes = lambda ok: [sum(told[r[0]][2][j] for r in rows if r[0] != i and ok(r)) for j in range(k)]
        lean = lambda own, prior, w: [(x + w * p) / (sum(own) + w) for x, p in zip(own, prior)]
        prior = lean(votes(lambda r: True), [1 / k] * k, k)
        if host is not None:
            prior = lean(votes(lambda r: r[2] is not None and domain(r[2]) == domain(host)), prior, fusion.domain)
            prior = lean(votes(lambda r: r[2] == host), prior, fusion.host)
        score = [x + math.log(p) for x, p in zip(score, prior)]
        for at, value in ((3, suffix), (4, declared)):
            if value is not None:
                values = len(Counter(r[at] for r in rows if r[at] is not None and told[r[0]][0]))
                same, every = votes(lambda r: r[at] == value), votes(lambda r: r[at] is not None)
                score = [x + math.log((s + 0.5) / (t + 0.5 * values)) for x, s, t in zip(score, same, every)]
        best = max(score)
        out[i] = (langs[score.index(best)], 1 / sum(math.exp(x - best) for x in score))
    return out
