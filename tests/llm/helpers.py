"""Brute-force counterparts and small tables of the tests in this folder."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_sets(text: str | None, size: int) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked_groups(rows: list[tuple], size: int, percent: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = [(d, word_sets(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}


def near_copies(rng, sizes=(9, 12, 31, 33, 64, 120), groups=8, most=12) -> list[tuple]:
    """(doc_id, text) of groups of edited copies, some around a common passage."""
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice(sizes))]
        if g % 3 == 0:
            base = passage + base[: rng.choice([5, 20])]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at, draw = rng.randrange(len(text)), rng.random()
                if draw < 0.4:
                    text[at] = rng.choice(words)
                elif draw < 0.7:
                    text.insert(at, rng.choice(words))
                elif len(text) > 2:
                    del text[at]
            out.append(" ".join(text))
    return list(enumerate(out))


MARKS = re.compile(r"^((?:[ \t]*>)+)")
HEADER = re.compile(r"(?i)^.{0,200}\b(wrote|schrieb|a écrit|escribió)\b.{0,100}:$")


def replies(rows: list[tuple]) -> list[tuple]:
    """(conv_id, position, turn, role, parent_turn, content) of (conv_id, turn, role, text) rows, message by message."""

    def norm(s):
        return re.sub(r"\s+", " ", s.lower()).strip(" ")

    conversations: dict = {}
    for conv, *message in rows:
        conversations.setdefault(conv, []).append(message)
    out = []
    for conv, messages in conversations.items():
        messages.sort(key=lambda m: tuple((x is not None, x if x is not None else 0) for x in m))
        parsed = []
        for _, _, text in messages:
            lines, whole = [], re.split(r"\r?\n", text or "")
            for line in whole:
                marks = MARKS.match(line)
                lines.append((marks.group(1).count(">") if marks else 0, MARKS.sub("", line).strip(" ")))
            own = [
                body
                for i, (level, body) in enumerate(lines)
                if level == 0 and not (HEADER.search(body) and i + 1 < len(lines) and lines[i + 1][0] > 0)
            ]
            parsed.append((lines, own, [w.strip(" ") for w in whole]))
        parents, contents = [], []
        for i, (lines, _, whole) in enumerate(parsed):
            gone: set = set()
            by_level: dict = {}
            for at, (level, body) in enumerate(lines):
                if level and norm(body):
                    by_level.setdefault(level, []).append((at, norm(body)))
            votes: dict = {}
            for level, found in by_level.items():
                runs: dict = {}
                for k, (at, body) in enumerate(found):
                    runs.setdefault(at - k, []).append((at, body))
                quotes = [("line", b, {at}) for at, b in found]
                quotes += [("all", " ".join(b for _, b in r), {at for at, _ in r}) for r in runs.values()]
                for kind, body, places in quotes:
                    hits = [
                        j
                        for j in range(i)
                        if body in ([norm("\n".join(parsed[j][1]))] if kind == "all" else [norm(o) for o in parsed[j][1]])
                    ]
                    if hits:
                        gone |= places
                        votes[level, hits[-1]] = votes.get((level, hits[-1]), 0) + len(body)
            kept = [
                w
                for k, w in enumerate(whole)
                if k not in gone and not (lines[k][0] == 0 and HEADER.search(lines[k][1]) and k + 1 in gone)
            ]
            contents.append(re.sub(r"^\n+|\n+$", "", "\n".join(kept)).strip(" "))
            best = min(((level, -w, -j) for (level, j), w in votes.items()), default=None)
            parents.append(-best[2] if best else i - 1 if i else None)
        order, todo = [], [0]
        while todo:
            at = todo.pop()
            order.append(at)
            todo.extend(reversed([i for i, p in enumerate(parents) if p == at]))
        for position, at in enumerate(order, 1):
            turn, role, _ = messages[at]
            above = None if parents[at] is None else messages[parents[at]][0]
            out.append((conv, position, turn, role, above, contents[at]))
    return out
