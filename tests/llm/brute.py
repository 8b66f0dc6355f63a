"""Plain Python forms of the contracts, written from their wording and not from the operators."""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def words(text):
    return WORD.findall(text or "")


def secrets(text):
    text = text or ""
    pats = [
        ("assign", re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    found = [
        (m.start(), i, kind, m.end())
        for i, (kind, p, g, least) in enumerate(pats)
        for m in p.finditer(text)
        if len(m[g]) >= least
    ]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def luhn(d):
    digits = [int(x) for x in d][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0


def personal(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def span_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def quality(text):
    w = words(text)
    text = text or ""
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if wins[tuple(w[i : i + 5])] >= 2:
            cover.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def shared_lines(docs, least=10):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < least]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter()
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(docs, n=400):
    data = {i: (t or "").encode() for i, t in docs}
    count = Counter(d[p : p + n] for d in data.values() for p in range(len(d) - n + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - n + 1):
            if count[d[p : p + n]] > 1:
                gone[p : p + n] = b"\x01" * n
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(d), sum(gone), spans, sha(kept))
    return out


def spelling(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            short = w[:p] + w[p + 1 :]
            holes[p, short].add(w)
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def conversations(rows):
    """``rows`` is (conv_id, turn, role, text); edits are found by trying all, remembered per place."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = after[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        if fault:
            kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {conv: _repaired(kept) for conv, kept in after.items()}


def _repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]

    @functools.cache
    def best(i, state, put=0):
        """(cost, audit, repaired) from row i on; states: 0 nothing, 1 system, 2 user, 3 assistant."""
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        due = "assistant" if state == 2 else "user"
        if put < 2:
            c, a, out = best(i, "ua".index(due[0]) + 2, put + 1)
            found.append((c + 3, "I" + a, ((due, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, state)
            found.append((c + 4, "D" + a, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                first = role[:1]
                if first == due[0] or first == "s" and state == 0:
                    c, a, out = best(i + 1, "sua".index(first) + 1)
                    found.append((c + more, "K" + a, ((role, text), *out)))
                c, a, out = best(i + 1, "ua".index(due[0]) + 2)
                found.append((c + 3 + more, "R" + a, ((due, text), *out)))
        return min(found) if found else (10**9, "", ())

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    cost, audit, out = best(0, 0) if rows else (0, "", ())
    sys.setrecursionlimit(limit)
    return (
        gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)),
    )
