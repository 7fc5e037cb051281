"""Plain restatements of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def token_counts(docs, library):
    out = []
    for i, t in docs:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        out.append((i, len((t or "").encode()), n, n > 2048))
    return out


def licenses(docs, phrases):
    out = []
    for i, t in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        out.append((i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    return out


def secrets(docs):
    kinds = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": ("AKIA[A-Z0-9]+", 0, 18), "hex": ("[0-9a-f]+", 0, 16)}
    out = []
    for i, t in docs:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, g, n)) in enumerate(kinds.items()) for m in re.finditer(p, t or "", re.ASCII) if len(m[g]) >= n]
        spans.sort()
        out.append((i, *(sum(s[2] == kind for s in spans) for kind in kinds), sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans))))
    return out


def shingle_sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def jaccard(docs):
    sets = shingle_sets(docs)
    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in sets.items()]


def bpe(docs, library):
    out = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return out


def token_files(docs, library):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: d[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def line_dedup(docs):
    key = lambda x: lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def top_k(vectors):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:20]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def leaks(docs, items):
    """Items of which a document holds every five-word shingle."""
    words = lambda t: lower(t or "").split()
    found = shingle_sets(docs)
    return {(i, j) for j, t in items if words(t) for i, s in found.items() if shingle_sets([(0, t)])[0] <= s}


def leak_scores(docs, items, threshold=0.5, size=5, overlap=0.75, answer_overlap=0.5, k1=1.2, b=0.75):
    """(doc, item): share of the item's BM25 score, of all that a document short enough to be one passage gives away."""
    of = {i: lower(t).split() for i, t in items}
    df = defaultdict(int)
    for w in of.values():
        for x in set(w):
            df[x] += 1
    mean, out = sum(map(len, of.values())) / len(of), {}
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    for d, t in docs:
        words = lower(t).split()
        for i, w in of.items():
            impact = {x: math.log(1 + (len(of) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (k1 + 1) / (w.count(x) + k1 * (1 - b + b * len(w) / mean)) for x in set(w)}
            score = sum(v for x, v in impact.items() if x in words) / sum(impact.values())
            n = min(size, len(w))
            n_answer = max(1, round(0.25 * len(w)))
            question, answer, there = w[:-n_answer], w[-n_answer:], runs(words, n)
            q = runs(question, min(n, len(question)))
            in_question = sum(x in there if len(x) == n else set(x) <= set(words) for x in q) / len(q)
            if score >= threshold and len(runs(w, n) & there) >= overlap * len(runs(w, n)) and in_question >= overlap and len(set(answer) & set(words)) >= answer_overlap * len(set(answer)):
                out[d, i] = score
    return out


def template_pattern(template):
    """A template as a regular expression over words, each with a blank in front; None for optional regions that begin with words of any kind."""
    out = ""
    for part in re.findall(r"<<[^<>]*>>|[^<>]+", template):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<var:"):
            out += f"(?: [^ ]+){{0,{part[6:-2]}}}"
        else:
            out += "".join(f" {re.escape(w)}" for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(part)))
    return re.compile(out + "(?= |$)")


def license_labels(docs):
    from strandline.llm.license_scan import PHRASES, TEMPLATES

    patterns = [(label, template_pattern(t)) for label, ts in TEMPLATES.items() for t in ts]
    out = []
    for i, t in docs:
        text = "".join(f" {w}" for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or "")))
        spans = {label for label, p in patterns if p.search(text)}
        base = {label for phrase, label in PHRASES.items() if f" {phrase} " in f"{text} "}
        out.append((i, ",".join(sorted(spans | base)), 1.0 if spans else 0.5 if base else 0.0))
    return out


def rising(y):
    """The rising sequence nearest to y: at each place the largest, over begins before it, of the least mean over ends behind it."""
    n, total = len(y), [0.0]
    for v in y:
        total.append(total[-1] + v)
    least = [[0.0] * n for _ in range(n)]
    for a in range(n):
        low = math.inf
        for e in range(n - 1, a - 1, -1):
            low = min(low, (total[e + 1] - total[a]) / (e + 1 - a))
            least[a][e] = low
    return [max(least[a][i] for a in range(i + 1)) for i in range(n)]
