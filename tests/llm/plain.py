"""Plain versions of the operators' contracts, and rows that every operator must handle."""

import hashlib
import random
import re
from collections import Counter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def odd_documents(seed=1):
    """(doc_id, text, lang, source, n_chars, node, score): nulls, empty and long texts, ties, repeated rows, clashing names."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (3, base + " more"), (4, None), (5, ""), (6, " \n\t"), (7, "x"), (8, "..., 123"), (None, base), (None, None), (9, text(9000)), (10, "Ünïcode " * 60), (11, base.upper())]
    rows += [(20 + k, base) for k in range(12)] + [(40 + k, text(rnd.randint(1, 200)) + " " + base[: rnd.randint(0, 500)]) for k in range(25)]
    rows += [(100, "same"), (100, "same"), (101, "a  b\r\nc"), (102, "a b c"), (103, "a" * 3000), (104, "日本語のテキスト " * 30), (105, "l'été 😀 fin")]
    return [(i, t, "xx", None, 0, b"n", 0.5) for i, t in rows]


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, node binary, score double"


def exact(rows):
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    return out


def decontaminated(rows, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        m = min(13, len(w))
        for s in range(len(w) - m + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                own = windows.get(tuple(w[s : s + m]))
                if own:
                    hit |= set(range(s, s + m))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def cut(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def near(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


SECRET = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def secrets(text):
    out = []
    for rank, (kind, pattern) in enumerate(SECRET):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    w = WORD.findall((text or "").translate(UPPER))
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))
