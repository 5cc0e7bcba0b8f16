"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hexed(text):
    return sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def secret_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def secrets(text):
    found = secret_spans(text)
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    return [sum(k == n for _, k, _ in found) for n in range(3)], told


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def near_documents(rows):
    """Per row: size of the set and least doc_id of the component."""
    sets = [shingles(r["text"]) for r in rows]
    groups = Groups(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i]["doc_id"] is not None and rows[j]["doc_id"] is not None:
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    groups.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            t = groups.top(i)
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    return [(len(s), None if r["doc_id"] is None else least[groups.top(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def shortened(rows):
    """Per row: words, words that go, and what is kept."""
    first = {}
    words = [WORD.findall(r["text"] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        if r["doc_id"] is not None:
            for p in range(len(w) - 49):
                key = tuple(w[p:p + 50])
                first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if r["doc_id"] is not None and first[tuple(w[p:p + 50])] < r["doc_id"]:
                gone[p:p + 50] = [True] * 50
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
    }


def verdicts(rows, least_rows, from_percent, guard):
    """Per row: counts, base_failed and kept."""
    found = [counts(r["text"]) for r in rows]
    part = lambda a, b: 10000 * a // b if b else 0
    shares = [
        {
            "symbol_share": part(c["n_symbols"], c["word_chars"]), "dup_line_share": part(c["n_dup_lines"], c["n_lines"]),
            "repeat_share": part(c["n_repeat_words"], c["n_words"]), "word_length": part(c["word_chars"], c["n_words"]),
        }
        for c in found
    ]

    def cell(x):
        return x >> max(0, x.bit_length() - 7) << max(0, x.bit_length() - 7)

    members = defaultdict(list)
    for n, r in enumerate(rows):
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            members[key].append(n)

    def limit(row, name):
        keys = [(row["lang"], row["source"]), (row["lang"],), ()]
        key = next((k for k in keys[:2] if len(members[k]) >= least_rows), ())
        cells = sorted(cell(shares[n][name]) for n in members[key])
        percentiles = [cells[-(-len(cells) * p // 100) - 1] for p in range(from_percent, 101)]
        splits = [a + (b - a) // 2 for a, b in zip(percentiles, percentiles[1:], strict=False) if b - a >= guard[name]]
        return splits[0] if splits else 10**18

    out = []
    for n, (r, c) in enumerate(zip(rows, found, strict=True)):
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out.append((c, failed, not failed and all(shares[n][k] <= limit(r, k) for k in guard)))
    return out


def masked(text, found, mask):
    out, at = "", 0
    for a, _, b in found:
        if a >= at:
            out += text[at:a] + mask
        at = max(at, b)
    return out + text[at:]
