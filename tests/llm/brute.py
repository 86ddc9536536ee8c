"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def quality(text):
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def base_scores(rows):
    """(id, text) -> id -> (held_out, n_tokens, n_known, N, base score)."""
    tokens = [(i, [*words(lower(t)), ""]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_components(rows, percent=80):
    """(id, text) -> id -> (n_shingles, component)."""
    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i)) for i in ids}


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


# -- quotations ---------------------------------------------------------------
def quotations(rows):
    """(conv, turn, text), each place once -> place -> (reply place or None, 'quote'/'turn'/None, n_quoted, n_linked)."""
    lines = {}
    for conv, turn, text in rows:
        own = []
        for line in re.split("\n", re.sub("\r\n?", "\n", text)):
            marks = re.match(r"([ \t]*>)*", line)[0]
            norm = re.sub(r"\s+", " ", line[len(marks) :].lower()).strip(" ")
            if norm:
                own.append((marks.count(">"), norm))
        lines[conv, turn] = own

    def places(passage):
        found = []
        for place, own in lines.items():
            said = [x for level, x in own if level == 0]
            if any(said[k : k + len(passage)] == passage for k in range(len(said) - len(passage) + 1)):
                found.append(place)
        return found

    def origin(passage, conv, turn):
        at = places(passage)
        before = [p for p in at if p[0] == conv and p[1] < turn]
        return (max(before) if before else min((p for p in at if p[0] != conv), default=None)), len(at)

    up, counts = {}, {}
    for (conv, turn), own in lines.items():
        runs = []
        for k, (level, x) in enumerate(own):
            if level:
                if k and own[k - 1][0] == level:
                    runs[-1][1].append(x)
                else:
                    runs.append((level, [x]))
        singles = [origin([x], conv, turn)[0] for _, run in runs for x in run]
        counts[conv, turn] = (len(singles), sum(o is not None for o in singles))
        votes = collections.defaultdict(float)
        for level, run in runs:
            pieces = [run] if origin(run, conv, turn)[0] else [[x] for x in run]
            for piece in pieces:
                o, n = origin(piece, conv, turn)
                if o:
                    votes[level, o] += len(piece) / n
        if votes:
            up[conv, turn] = max(votes, key=lambda k: (-k[0], round(votes[k], 9), k[1][0] == conv, k[1]))[1]
    heads = set()
    for start in up:
        seen, at = [], start
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            heads.add(min(seen[seen.index(at) :]))
    out = {}
    for place in lines:
        quoted = up.get(place) if place not in heads else None
        before = (place[0], place[1] - 1)
        out[place] = (quoted, "quote", *counts[place]) if quoted else (before, "turn", *counts[place]) if before in lines else (None, None, *counts[place])
    return out


# -- disclosure ---------------------------------------------------------------
def sensitive(texts, width, min_contexts, disclose, remove):
    """term -> removed, from the definition: all entities and terms of all distinct texts."""
    from tarnlake.llm import pii as p

    near, holds = collections.defaultdict(lambda: (set(), set())), collections.defaultdict(set)
    has = collections.defaultdict(set)
    for text in set(texts):
        for t in re.findall(r"[^\W_]{2,}", text):
            holds[t.lower()].add(text)
        spans = p.entity_spans(text)
        covered = {k for _, a, b in spans for k in range(a, b)}
        terms = [m for m in re.finditer(r"[^\W_]{2,}", text) if not covered & set(range(*m.span()))]
        for kind, a, b in spans:
            before = [m[0].lower() for m in terms if m.start() <= a][-width:]
            after = [m[0].lower() for m in terms if m.start() > a and m.start() > b][:width]
            for e in p.entities(kind, text[a:b]):
                has[e].add(text)
                for t in {*before, *after}:
                    near[e, t][0].add(text)
                    near[e, t][1].add(" ".join(before + after))
    n, out = len(set(texts)), {}
    for (e, t), (own, contexts) in near.items():
        if len(contexts) >= min_contexts and 2 * len(has[e]) < n:
            d = 1 + math.log2(len(own) / len(holds[t])) / math.log2(n / len(has[e]))
            if d >= disclose:
                out[t] = max(out.get(t, 0), d)
    return {t: d >= remove for t, d in out.items()}


def prefix_trie(turns):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    (conv_id, turn, role, text); turns of one place go by the digest of (role, text)."""
    own: dict = {}
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members: dict = {}
    ends: dict = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = tuple(own.get(c - c % 20, [])[:h] + v[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], set()).add(c)
        ends.setdefault(rebuilt, []).append(c)
    out = []
    for p in members:
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) > len(q) and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(words(q[-1][1] if q else "")) for q in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), len(leaves), saved, sha))
    return out


def vector_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, codebooks) of (vec_id, vector, label), all of one length, by all distances."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    start = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0],))[:entries]
    books = [[list(cut[k][p]) for k in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own: dict = {}
            for x in cut:
                own.setdefault(nearest(p, x[p])[1], []).append(x[p])
            for j, xs in own.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    total: dict = {}
    for (_, _, lab), f in zip(kept, found, strict=True):
        total[lab] = total.get(lab, 0) + sum(d for d, _ in f)
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return [(i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), total[lab], hashlib.sha256(flat.encode()).hexdigest()) for (i, _, lab), f in zip(kept, found, strict=True)]


def mix_targets(by_source, weights=(3, 1, 2), share=1.5, most=2):
    """Target of each source (None: no source), by sharing again until none is above its most."""
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_ = share * sum(by_source.values()), set(names)
    out: dict = {}
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * per > most * by_source[s]}
        if not over:
            return out | {s: w[s] * per for s in open_}
        for s in over:
            out[s] = float(most * by_source[s])
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out
