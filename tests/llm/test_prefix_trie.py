import hashlib
import random
import zlib

import pytest

from standtally.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, parent string"


def plain(rows):
    """Nodes by building the trie itself."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == list(path))
        out.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves),
            saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def got(spark, rows, **options):
    df = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), **options)
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def sample(seed, n, ids=400, vocabulary=3, turns=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, ids), n):
        for turn in range(rng.randrange(1, turns)):
            text = " ".join(rng.choice("ab") for _ in range(rng.randrange(vocabulary)))
            rows.append((c, turn, rng.choice(["user", "bot"]), text, 1, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [prefix_trie.MAX_CELLS, 1024])
def test_random_conversations(spark, cells):
    rows = sample(cells, 260)
    assert got(spark, rows, cells=cells) == plain(rows)


def test_long_conversations_copies_and_chains(spark):
    rng = random.Random(3)
    long = [(rng.choice(["u", "b"]), f"turn {i} {rng.random()}") for i in range(900)]
    rows = [(c, i, r, t, 0, None) for c in (7, 8, 500, 1003) for i, (r, t) in enumerate(long)]
    # Each conversation is the one before it and a turn more, so that paths hang in a chain.
    rows += [(2000 + c, i, "u", f"step {i}", 0, None) for c in range(30) for i in range(c + 1)]
    # Many copies of one conversation, and one first turn before many others.
    rows += [(3000 + c, i, "u", t, 0, None) for c in range(120) for i, t in enumerate(["same", "same again", "end"])]
    rows += [(6000 + c, i, "u", t, 0, None) for c in range(150) for i, t in enumerate(["hello there", f"own {c}"])]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, 1, "x"), (1, None, "", "", 1, "x"), (1, 2, "user", "a b  c\x0b d", 1, "x"),
        (1, 2, "user", "a b  c\x0b d", 1, "x"), (2, 0, "us", "er", 1, "x"), (3, 0, "user", "", 1, "x"),
        (None, 0, "user", "nobody", 1, "x"), (21, 0, "u", "first", 1, "x"), (21, 1, "u", "second", 1, "x"),
        (41, 5, "u", "z", None, None), (41, 5, "u", "b" * 100_000, None, None), (41, 5, "a", "日本 語", None, None),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == set()
    assert got(spark, rows[4:5]) == plain(rows[4:5])
