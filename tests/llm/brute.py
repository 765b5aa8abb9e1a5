"""Plain Python versions of the operators, straight from their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter

BLANK = r"[\x20\x09-\x0D]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def pii(text):
    found = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for rank, (kind, pattern, ok) in enumerate(rules):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return sorted(found)


def secrets(text):
    found = []
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
             ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for rank, (kind, pattern, ok) in enumerate(rules):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m)]
    return sorted(found)


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def repeated_bytes(texts, length=100):
    """Per text (in order of precedence) the kept bytes and the number of removed runs."""
    seen, out = set(), []
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(s)
        out.append((bytes(b for b, m in zip(t, mask) if not m), sum(1 for _ in re.finditer(b"\1+", bytes(mask)))))
    return out


def shingles(text, size=5):
    words = [w for w in re.split(BLANK + "+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def linked(sets, percent=80):
    """Index pairs of sets that reach the similarity."""
    out = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                out.append((i, j))
    return out


def classes(n, pairs):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = top(i), top(j)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def repeated_lines(texts, run=3, words=None):
    """Per text (in order of precedence) the lines that stay."""
    seen, out = set(), []
    for t in texts:
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines)):
            for size in range(1, min(run, len(lines) - p) + 1):
                g = tuple(lines[p : p + size])
                if size == run or (words is not None and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in g) >= words):
                    if g in seen:
                        gone.update(range(p, p + size))
                    seen.add(g)
        out.append([x for i, x in enumerate(lines) if i not in gone])
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks(text, items, window=10):
    words, hit, names = bench_words(text), set(), set()
    for name, item in items:
        w = bench_words(item)
        m = min(window, len(w))
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in grams:
                hit.update(range(i, i + m))
                names.update([] if name is None else [str(name)])
    return len(words), len(hit), len(names), sha(",".join(sorted(names)))


def spelling(docs, least=6, count=5, ratio=5):
    """Rows (word, form, root, n, n_near, form_n) of documents (id, text), every pair of words compared."""
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in found.items() if len(w) >= least and n >= count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()]


def spliced(rows, group=100, most=6):
    """Rebuilt conversations {c: [(role, text)]} of rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted(
        (r for r in rows if r[0] is not None),
        key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()),
    ):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % group, [])[:h] + turns[h:]
    return out


def prefixes(convs):
    """Rows of the trie of conversations {c: turns}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, sha(ends)))
    return out


def language(model, text):
    """(language, score) of a text by an averaged bag of its byte n-grams, one at a time."""
    from stewardspark.llm import language as m

    raw = (" " + text.lower()).encode("utf-8", "replace") + b" "
    raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in raw)
    total, count = [0.0] * len(model.languages), 0
    for size in m.SIZES:
        for k in range(len(raw) - size + 1):
            gram = raw[k : k + size]
            if 32 in gram[1:-1] or (size > 1 and gram[0] == 32 == gram[-1]):
                continue
            code = 0
            for c in gram:
                code = (code * 257 + c + 1) % (1 << 64)
            bucket = (code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - m.BUCKET_BITS)
            total = [t + float(x) for t, x in zip(total, model.logits[bucket])]
            count += 1
    z = [(t / max(1, count) + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(e)), key=lambda k: e[k])
    return model.languages[best], e[best] / sum(e)


def toxicity(model, text):
    """Score of a text: every filter at every position, the strongest response of each, one sum."""
    from stewardspark.llm import toxicity as m

    words = [m._buckets(w) for w in re.findall(r"\w+", (text or "").lower())]
    size = len(model.embed[0])
    vectors = [[sum(float(model.embed[b][d]) for b in bs) for d in range(size)] for bs in words]
    pad = [[0.0] * size] * (max(m.WIDTHS) - 1)
    vectors = pad + vectors + pad
    z = model.bias
    for k, (filters, offsets) in enumerate(zip(model.filters, model.offsets)):
        for f in range(m.FILTERS):
            best = 0.0
            for p in range(len(vectors) - len(filters) + 1):
                y = float(offsets[f]) + sum(x * float(w[f]) for j, row in enumerate(filters) for x, w in zip(vectors[p + j], row))
                best = max(best, y)
            z += best * float(model.output[k * m.FILTERS + f])
    guess = [sum(float(model.profile[bs[0]][c]) for bs in words) for c in range(len(model.languages))]
    cut = float(model.cuts[guess.index(max(guess)) if guess and words else 0])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.scale * (z - cut)))))
