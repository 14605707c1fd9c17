"""Plain, slow versions of the operators, to test against."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, k=3):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, distance=2):
    """{fingerprint: least linked fingerprint} over all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, n=10):
    """{doc_id: (n_words, n_hit, n_items, sha)} for docs {id: text}."""
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i:i + size])].add("null" if item is None else str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w = BENCH_WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i:i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out[doc] = (len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def base_statistics(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def token_rows(docs, path, end_id=2):
    """(doc_id, start, n, crc) in ascending id order."""
    from tokenizers import Tokenizer
    tok, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(docs):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


def water_fill(sizes, weights, budget=1.5, limit=2):
    """Targets by sharing the excess again and again."""
    target, open_, left = {}, dict(weights), budget * sum(sizes.values())
    while open_:
        share = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / share > limit * sizes[s]]
        if not over:
            target.update({s: left * w / share for s, w in open_.items()})
            break
        for s in over:
            target[s] = limit * sizes[s]
        left -= sum(limit * sizes[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    return target


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k=10):
    """[(item, rank, doc, score)] over rows (doc, text) and (item, text)."""
    bags = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = defaultdict(Counter)
    for item, t in items:
        asked[item].update(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c, size in bags:
            m = 25 + (75 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                found.append((-s, d is not None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(docs, min_docs=3, top=200):
    """Rows of the audit over rows (text, lang, source)."""
    held, groups = defaultdict(set), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(docs):
        terms = LETTERS.findall(lower(text))
        groups[lang or "", source or ""].update(terms)
        for t in terms:
            held[lang or "", t].add(i)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), rows in held.items() if x == lang and len(rows) >= min_docs]
        sources = {s: c for (x, s), c in groups.items() if x == lang}

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p = {s: prices(c) for s, c in sources.items()}
        q = prices(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in sources.items():
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if c[t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the base spans."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    holds = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.group().split(".")),
             "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
             "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [(kind, m.start(), m.end()) for kind, p in
            (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
            for m in p.finditer(text or "") if holds[kind](m)]
