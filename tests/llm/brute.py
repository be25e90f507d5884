"""Plain restatements of the llm contracts, against which the operators are tested."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k=5):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_duplicates(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in inverted[x] if j < i)
        for j, n in shared.items():
            a, b = rows[i][0], rows[j][0]
            if a is not None and b is not None and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = []
    for (d, _), s in zip(rows, sets):
        c = find(d) if d is not None else None
        out.append((d, len(s), c, d is None or c == d))
    return out


def remove_repeats(rows, k=35):
    starts = Counter()
    texts = [words(t) for _, t in rows]
    for w in texts:
        starts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if starts[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def top_k(rows, every=50, k=5):
    """Every row is a candidate for every other row; scores are whole numbers of any size."""
    fine = [(d, [math.floor(256 * x) for x in v]) for d, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(fine):
        if q is None or q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), d is None, d or 0) for i, (d, w) in enumerate(fine) if i != at and len(w) == len(v))
        out += [(q, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(scores[:k])]
    return out


def entropy_spans(text, base, rules, candidate, alphabet_class):
    """Spans of candidates that no base span covers, counted window by window."""
    out = []
    for m in re.finditer(candidate, text):
        if any(a <= m.start() and m.end() <= e for a, _, _, e in base):
            continue
        t = m[0]
        if any(re.search(p, t) and not (unless and re.search(unless, t)) for p, unless in rules.allowed):
            continue
        windows = [t[i : i + rules.window] for i in range(len(t) - rules.window + 1)]
        most = max(-sum(n / rules.window * math.log2(n / rules.window) for n in Counter(w).values()) for w in windows)
        if most >= rules.thresholds[alphabet_class(t)] - 1e-9:
            out.append((m.start(), m.end()))
    return out


SECRET = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def secrets(text):
    spans, counts = [], []
    for k, (name, (pattern, group, least)) in enumerate(SECRET.items()):
        found = [m for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(found))
        spans += [(m.start(), k, name, m.end()) for m in found]
    digest = ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans))
    return (*counts, hashlib.sha256(digest.encode()).hexdigest()), sorted(spans)


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path, rules):
    best = None
    for r, verdict in rules.items():
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, verdict)
    return best or (None, None)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def mix_targets(sizes, most=3):
    """Targets by source: repeat capping until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def fill_middle(rows, unit=None):
    """Per (id, text): n, form, prefix and middle lengths, output and restored digests."""
    sha, out = lambda t: hashlib.sha256(t.encode()).hexdigest(), []
    for i, raw in rows:
        text = raw or ""
        units = re.findall(unit, text) if unit else list(text)
        h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            form, output = "plain", text
        elif h[3] % 100 < 20:
            form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
        else:
            form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
        plain = form == "plain"
        out.append((i, len(units), form, None if plain else len(prefix), None if plain else len(middle), sha(output), sha(text)))
    return out


def contaminated(rows, items, window=10):
    """Per document: id, words, hit words, items, digest of their names, contaminated; every window at every place."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wanted = {}
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[s : s + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for size in {len(x) for x in wanted}:
            for s in range(len(w) - size + 1):
                if names := wanted.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def product_codes(rows, parts=16, entries=64, rounds=2):
    """Per kept (id, label, vector): id, code, error, error of its label, digest of the codebooks; every distance worked out."""
    kept = [r for r in rows if r[2] is not None and all(v is not None and math.isfinite(v) for v in r[2])]
    cut = {}
    for k, (_, _, x) in enumerate(kept):
        codes, w = [math.floor(256 * v) for v in x], len(x) // parts
        cut[k] = [codes[p * w : p * w + w] for p in range(parts)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((distance(x, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(p, cut[k][p])[1] for p in range(parts)] for k in range(len(kept))]
        moved = [list(b) for b in books]
        for p in range(parts):
            for j in set(f[p] for f in found):
                mine = [cut[k][p] for k in range(len(kept)) if found[k][p] == j]
                moved[p][j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
        books = moved
    coded = [[nearest(p, cut[k][p]) for p in range(parts)] for k in range(len(kept))]
    errors, labels = [sum(d for d, _ in c) for c in coded], {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in c), e, labels[label], digest) for (i, label, _), c, e in zip(kept, coded, errors, strict=True)]
