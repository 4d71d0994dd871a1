"""Brute-force versions of operators, for the tests."""

import hashlib
import re

from assayer.llm import mixing, pii


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    inside = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def brute_kept(text):
    """The verdict of the quality rules, from n-grams as tuples and lines as strings."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) < 10 or 100 * brute_quality(text)[4] > 20 * len(w):
        return False
    chars = sum(map(len, w))
    for n, limit in ((5, 0.25), (7, 0.22), (10, 0.20)):
        places = {}
        for k in range(len(w) - n + 1):
            places.setdefault(tuple(w[k : k + n]), []).append(k)
        inside = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(n)}
        if sum(len(w[k]) for k in inside) / chars > limit:
            return False
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += len(line) if line in seen else 0
            seen.add(line)
    return again / len(text) <= 0.30


def brute_shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, similarity=0.8, width=5):
    """{place in rows: smallest id} by linking all pairs of (id, text) at that Jaccard similarity."""
    sets = [brute_shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= similarity * union:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [ids[g] for g in group]


def brute_mix(rows, weights, share, max_epochs, seed=5):
    """Budgets by filling children until none is over its share; prefixes by a plain walk."""
    docs = [(i, domain, lang, source, len((t or "").split())) for i, t, domain, lang, source in rows]

    def fill(children, pool):
        got, full = {}, set()
        while True:
            free = {c: w for c, (room, w) in children.items() if c not in full}
            left = pool - sum(children[c][0] for c in full)
            total = sum(free.values())
            over = [c for c, w in free.items() if w == 0 or children[c][0] * total <= left * w]
            if not over:
                got = {c: (children[c][0] if c in full else min(children[c][0], left * w // total)) for c, w in {**dict.fromkeys(full, 0), **free}.items()}
                return got
            for c in over:
                if free[c] == 0:
                    children[c] = (0, 0)
            full |= set(over)

    def below(path):
        return sum(n for _, *p, n in docs if tuple(p[: len(path)]) == path) * max_epochs

    def spread(path, pool):
        if len(path) == 3:
            return {path: pool}
        names = sorted({p[len(path)] for _, *p, _ in docs if tuple(p[: len(path)]) == path})
        of = weights.get(mixing.LEVELS[len(path)], {})
        budgets = fill({c: (below((*path, c)), of.get(c, 1)) for c in names}, pool)
        return {k: v for c in names for k, v in spread((*path, c), budgets[c]).items()}

    budgets = spread((), int(sum(d[-1] for d in docs) * share))
    out = []
    for leaf, budget in budgets.items():
        mine = [(i, n) for i, *p, n in docs if tuple(p) == leaf]
        tokens = sum(n for _, n in mine)
        epochs = budget // tokens if tokens else 0
        rest = budget - epochs * tokens
        key = lambda x: (hashlib.md5(f"{seed}|{epochs}|{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0, x[1])  # noqa: E731,B023
        used = 0
        for i, n in sorted(mine, key=key):
            used += n
            out.append((i, *leaf, n, budget, epochs + (0 < n and used <= rest)))
    return sorted(out, key=str)


BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_base(text):
    """(kind, start, end) by the patterns of the job as they stand."""
    out = []
    for kind, shape in enumerate(BASE):
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {0: True, 1: all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 2: 16 <= len(digits) <= 19 and luhn, 3: 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def brute_pii(rows, support=5, min_score=0.8, min_confidence=0.9):
    """{id: spans text} by pattern tables held in dictionaries and rounds over all of them."""
    docs = {}
    for i, t in rows:
        t = t or ""
        base = brute_base(t)
        marks = [(k, s, e, True) for k, s, e in base]
        for kind, shape in [(4, pii.KEY), *pii.LOOSE.items()]:
            new = [m.span() for m in shape.finditer(t) if (kind == 4 or pii._loose_fits(kind, m[0])) and not any(m.start() < e and s < m.end() for _, s, e, _ in marks)]
            marks += [(kind, s, e, kind == 4) for s, e in new]
        spots, at = [], 0
        for mark in sorted(marks, key=lambda m: (m[1], -m[2])):
            if mark[1] >= at:
                spots += [(x, None) for x in _words(t, at, mark[1])] + [((mark[1], mark[2]), mark)]
                at = mark[2]
        spots += [(x, None) for x in _words(t, at, len(t))]
        docs[i] = (t, base, marks, spots)
    name = lambda t, spot: f"<{pii.KINDS[spot[1][0]]}>" if spot[1] else t[slice(*spot[0])].lower()
    value = lambda k, x: re.sub("[^0-9]", "", x) if k in (2, 3) else x.lower()
    slots = []  # (id, span, kind, seed, instance, patterns)
    for i, (t, _, _, spots) in docs.items():
        names = ["^", "^", *(name(t, s) for s in spots), "$"]
        for n, (span, mark) in enumerate(spots, 2):
            around = {f"L {names[n - 1]}", f"LL {names[n - 2]} {names[n - 1]}", f"R {names[n + 1]}", f"B {names[n - 1]} {names[n + 1]}"}
            if n == 2:
                around = {"L ^", "LL ^ ^", f"R {names[n + 1]}", f"B ^ {names[n + 1]}"}
            text = t[slice(*span)]
            kind = mark[0] if mark else (5 if re.search("[0-9@_]", text) else None)
            slots.append((i, span, kind, bool(mark and mark[3]), None if kind is None else value(kind, text), around))
    seeds = {}
    for _, _, kind, seed, inst, around in slots:
        for p in around if seed else ():
            seeds.setdefault((p, kind), set()).add(inst)
    seeds = {x: v for x, v in seeds.items() if len(v) >= support}
    fillers, plain = {}, {}
    for _, _, kind, seed, inst, around in slots:
        for p in around:
            if kind is None:
                plain[p] = plain.get(p, 0) + 1
            else:
                fillers.setdefault(p, set()).add((kind, inst, seed))
    sure, score = {}, {}
    for _ in range(50):
        score = {}
        for (p, k), of in seeds.items():
            more = sum(sure.get((k, inst), 0) for own, inst, seed in fillers[p] if not seed and own in (k, 5))
            x = min(0.999, (len(of) + more) / (len(fillers[p]) + plain.get(p, 0)))
            if x >= min_score:
                score[p, k] = x
        wrong = {}
        for p, k in score:
            for own, inst, seed in fillers[p]:
                if not seed and own in (k, 5):
                    wrong[k, inst] = wrong.get((k, inst), 1) * (1 - score[p, k])
        sure = {x: 1 - w for x, w in wrong.items()}
    found = {i: set() for i in docs}
    for i, (t, _, marks, _) in docs.items():
        found[i] |= {(k, s, e) for k, s, e, seed in marks if not seed and sure.get((k, value(k, t[s:e])), 0) >= min_confidence}
    for i, span, kind, _seed, _, around in slots:
        if kind in (4, 5):
            chances = {}
            for p in around:
                for k in range(5):
                    if (p, k) in score and kind in (k, 5):
                        chances[k] = chances.get(k, 1) * (1 - score[p, k])
            good = [(round(1 - w, 9), -k) for k, w in chances.items() if 1 - w >= min_confidence]
            if good:
                found[i].add((-max(good)[1], *span))
    return {i: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted({*found[i], *docs[i][1]})) for i in docs}


def _words(text, start, end):
    for m in re.compile(r"[^\x20\x09-\x0D]+").finditer(text, start, end):
        word = m[0].strip(pii.EDGE)
        if word:
            at = m.start() + len(m[0]) - len(m[0].lstrip(pii.EDGE))
            yield at, at + len(word)
