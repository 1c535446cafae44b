"""Plain Python versions of the conversation operators, for tests."""

import hashlib
import re
import zlib
from collections import defaultdict

WHITE = " \t\n\v\f\r"


def trie(rows, rebuilt=True):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of rows (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    seq = {}
    for own in turns.values():
        own.sort()
    for c, own in turns.items():
        if rebuilt:
            h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -((-c) % 5))
            own = turns.get(base, [])[:h] + own[h:]
        seq[c] = tuple((t[2], t[4]) for t in own)
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in sorted(seq):
        ends[seq[c]].append(c)
        for d in range(len(seq[c]) + 1):
            members[seq[c][:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    named = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    out = [(members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], named(k)) for k in members]
    return sorted(out, key=lambda r: r[:2])


def damage(rows):
    ids, out = set(), []
    for c, t, r, x in rows:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return ids, out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        s = x.strip(WHITE)
        out.append(1 if not s else 2 if (r, x) in seen else 3 if s[-1] not in ".!?" else 0)
        seen.add((r, x))
    return out


def all_edits(rows, found):
    """The cheapest repair of a few rows, by all edits whose roles can still become right and which cost no more than deleting everything."""

    def right(ways):
        return [w for w in ways if re.fullmatch(r"(s?(ua)*u?)?", w[2]) and w[0] <= 2 * len(rows)]

    def with_inserts(ways):
        more = ways
        for _ in range(2):
            more = right([(cost + 5, audit + "I", roles + name[0], [*out, (name, "")]) for cost, audit, roles, out in more for name in ("user", "assistant")])
            ways = ways + more
        return ways

    ways = [(0, "", "", [])]
    for (_, _, r, x), fault in zip(rows, found, strict=True):
        new = []
        for cost, audit, roles, out in with_inserts(ways):
            new.append((cost + 2, audit + "D", roles, out))
            if fault in (1, 2):
                continue
            more = cost + 5 * (fault == 3)
            if r[:1] in ("s", "u", "a"):
                new.append((more, audit + "K", roles + r[:1], [*out, (r, x)]))
            new += [(more + 1, audit + "R", roles + name[0], [*out, (name, x)]) for name in ("user", "assistant")]
        ways = right(new)
    return min((w for w in with_inserts(ways) if re.fullmatch(r"(s?(ua)+)?", w[2])), key=lambda w: w[:2])


def repair(rows, damaged=True):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) and the repaired turns by conv_id."""
    ids, rows = damage(rows) if damaged else ({r[0] for r in rows}, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    by = {c: [] for c in ids}
    for r in rows:
        by[r[0]].append(r)
    out, turns = [], {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        found, places = faults(own), [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, _, turns[c] = all_edits(own, found)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns[c]).encode()).hexdigest()
        out.append((c, max(places) - min(places) + 1 - len(set(places)) if places else 0, found.count(1), found.count(2), found.count(3), illegal, cost,
            audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0)), turns
