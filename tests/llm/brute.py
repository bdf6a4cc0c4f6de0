"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_documents(rows, k, percent=80):
    """rows: (doc_id, text) -> {doc_id: (size, component)}"""
    sets = {i: shingles(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for at in holders.values():
        if len(at) <= 400:
            both.update((a, b) for n, a in enumerate(at) for b in at[n + 1 :])
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    # frequent shingles: pairs that share nothing else can't be similar unless their sets are tiny
    frequent = {x for x, at in holders.items() if len(at) > 400}
    small = [i for i, s in sets.items() if s & frequent]
    for n, a in enumerate(small):
        for b in small[n + 1 :]:
            la, lb = len(sets[a]), len(sets[b])
            if min(la, lb) * 100 >= percent * max(la, lb):
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (la + lb - inter):
                    links.append((a, b))
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def repeated_bytes(texts, length):
    """For each text (bytes): (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    count = Counter()
    for t in texts:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        left = bytes(np.frombuffer(t, np.uint8)[~mask])
        out.append((len(t), int(mask.sum()), int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(t) else 0, hashlib.sha256(left).hexdigest()))
    return out


def without_repeats(texts, length):
    """Texts (bytes) without the bytes that repeated strings cover; cuts shrink to whole characters."""
    count = Counter()
    for t in texts:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left, at = [], 0
        while at < len(t):
            end = at + 1
            while end < len(t) and t[end] & 0xC0 == 0x80:
                end += 1
            if not gone[at:end].all():
                left.append(t[at:end])
            at = end
        out.append(b"".join(left))
    return out


def copies(rows, exponent, seed):
    """rows: (doc_id, source, text) -> {doc_id: rows of the mix with that id}."""
    size = Counter()
    for _, source, text in rows:
        size[source or ""] += len(text or "")
    weight = {s: n**exponent if n else 0.0 for s, n in size.items()}
    out = Counter()
    for i, source, _ in rows:
        s = source or ""
        rate = round(weight[s] / sum(weight.values()) * sum(size.values()) / size[s], 9) if size[s] else 0.0
        u = int(hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, np.exp(-rate)
        total = p
        while rate > 0 and u >= total and n < 300:
            n += 1
            p *= rate / n
            total += p
        out[i] += n
    return out


def article(page):
    """The text of a page's <article>: blocks joined by one space."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        depth, blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag not in ("b", "br"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag != "b":
                self.blocks.append("")

        def handle_data(self, data):
            if self.depth:
                self.blocks[-1] += data

    reader = Reader()
    reader.blocks = [""]
    reader.feed(page or "")
    reader.close()
    return " ".join(" ".join(x.split()) for x in reader.blocks if x.strip())


def quality_verdicts(rows):
    """rows: {doc_id: (lang, source, five counts)} -> ({doc_id: kept}, ids so near a limit that rounding decides, {(lang, source): limits}).

    The limits as the docstring of quality_rules states them, from exact quantiles.
    """
    ranks, units = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995, 1.0), {"symbols": (4, 1), "lines": (5, 1), "repeats": (6, 16)}
    ok = {i: r for i, r in rows.items() if not (r[2] < 20 or 100 * r[6] > 30 * r[2])}
    quantiles = lambda values, at: np.sort(values)[[max(0, int(np.ceil(q * len(values))) - 1) for q in at]]
    typical = quantiles([r[2] for r in ok.values()], [0.5])[0] if ok else 1
    scaled = lambda r, m: np.log1p(r[units[m][0]] / units[m][1] * min(1, typical / max(r[2], 1)))
    values = {m: (lambda r, m=m: scaled(r, m)) for m in units} | {"mean": lambda r: r[3] / max(r[2], 1)}

    def pulled(lang, source, m):
        at = ranks if m in units else (0.25, 0.5, 0.75)
        levels = [[values[m](r) for r in ok.values() if f(r)] for f in (lambda r: True, lambda r: r[0] == lang, lambda r: r[:2] == (lang, source))]
        whole = quantiles(levels[0], at)
        parent = (len(levels[1]) * quantiles(levels[1], at) + 10 * whole) / (len(levels[1]) + 10)
        return (len(levels[2]) * quantiles(levels[2], at) + 10 * parent) / (len(levels[2]) + 10), parent, whole

    kept, near, limits = dict.fromkeys(rows, False), set(), {}
    for group in {r[:2] for r in ok.values()}:
        own = {}
        for m in units:
            q = pulled(*group, m)[0]
            step, middle = max(zip(np.diff(q), (q[1:] + q[:-1]) / 2, strict=True))
            own[m] = middle if step >= np.log(8) else np.inf
        me, up, whole = pulled(*group, "mean")
        for sign in (1, -1):
            fence = lambda q: sign * (q[1 + sign] - q[1]) + 3 * sign * (q[1 + sign] - q[1 - sign])  # noqa: B023, E731
            own[sign] = me[1] + sign * max(sorted(map(fence, (me, up, whole)))[1], 7 * sign * (me[1] - me[1 - sign]))
        limits[group] = own
    for i, r in ok.items():
        own, over = limits[r[:2]], []
        for m in units:
            over.append((scaled(r, m) - own[m], 1e-9))
        for sign in (1, -1):
            expected = max(own[sign], 0) * r[2]
            over.append((sign * (r[3] - expected) - 3 * max(expected, 1) ** 0.5, 0.05 * (1 + expected)))
        kept[i] = not any(x > 0 for x, _ in over)
        if any(abs(x) < slack for x, slack in over):
            near.add(i)
    return kept, near, limits


def near_vectors(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (a, x) in enumerate(good):
        for b, y in good[n + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
    comp = components([i for i, _ in rows], links)
    n = Counter(x for pair in links for x in pair)
    return {i: (n[i], comp[i]) for i, _ in rows}


def pieces_hold(rows, pieces, tokenizer, window=2048):
    """Checks pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of distinct documents (doc_id, text)."""
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
    assert len(by_doc) == len(rows)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[i], key=lambda p: p[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p[5]].append((p[6], p[2]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    total = sum(p[2] for p in pieces)
    assert len(by_seq) == -(-total // window)


def periodic_runs(words):
    """[(start, length, period)] of a list of words, by the definition."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    """{(item, rank): (doc_id, score)} of rows (id, text), by the formula."""
    found = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(terms(text))
    out = {}
    for item, own in asked.items():
        scores = []
        for i, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            weight = lambda t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1))))
            score = sum(r * weight(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in own.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (i, -score)
    return out


def nearest(rows, queries, k=10):
    """{(query, rank): (vec_id, distance)} of rows (id, vector) with distinct ids."""
    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            near = []
            for i, y in good:
                if i != q and len(x) == len(y):
                    total = 0.0
                    for a, b in zip(x, y, strict=True):
                        total += (a - b) * (a - b)
                    near.append((total**0.5, i))
            out |= {(q, rank): (i, d) for rank, (d, i) in enumerate(sorted(near)[:k], 1)}
    return out


def toxic_lexicon(rows, folds):
    """{term: log-odds} of rows (text, toxic, fold) in ``folds``, as the docstring of toxicity states it."""
    rows = [r for r in rows if r[2] in folds]
    n = [sum(r[1] == t for r in rows) for t in (0, 1)]
    counts = [Counter(), Counter()]
    for text, label, _ in rows:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        counts[label].update(words | {w[:k] + "-" for w in words for k in (4, 5, 6, 7) if len(w) > k})
    total = max(2, sum(n))
    least = max(3, int(np.ceil(np.log(10 * total) / -np.log(min(0.5, max(n[1], 1) / total)))))
    out = {}
    for term, c1 in counts[1].items():
        c0 = counts[0][term]
        expected = (c0 + c1) * n[1] / total
        odds = np.log((c1 + 0.5) / (n[1] + 1)) - np.log((c0 + 0.5) / (n[0] + 1))
        if c1 >= least and c1 - expected >= 4.5 * expected**0.5 and odds >= 1.5:
            out[term] = odds
    return out
