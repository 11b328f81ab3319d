"""Operators against plain versions of their definitions, written apart from them, on small random tables."""

import collections
import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from registrum.llm import catalogue, chat, linededup, minhash, secrets

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


# ---- substring dedup


def _gone(texts, least):
    """Words (row, place) that go: those of repeated lines and paragraphs, and of windows that stand before."""
    size, out = linededup.WINDOW, set()
    words = [[m.span() for m in re.finditer(r"[^\t-\r ]+", t or "")] for t in texts]
    seen = {}
    for row, t in enumerate(texts):
        for pattern in (r"[^\n]+(?:\n(?![ \t]*\n)[^\n]+)*", r"[^\n]+"):
            for m in re.finditer(pattern, t or ""):
                shape = " ".join(m[0].lower().split()).strip(".,;:!?\"'()[]- ")
                if len(shape.split(" ")) < least:
                    continue
                first = seen.setdefault(shape, (row, m.start(), m.end()))
                if first != (row, m.start(), m.end()) and not (first[0] == row and m.start() < first[2]):
                    out |= {(row, k) for k, (a, b) in enumerate(words[row]) if m.start() <= a and b <= m.end()}
    seen = {}
    for row, t in enumerate(texts):
        low = [t[a:b].lower() for a, b in words[row]]
        for k in range(len(low) - size + 1):
            first = seen.setdefault(tuple(low[k : k + size]), (row, k))
            if first[0] != row or first[1] + size <= k:
                out |= {(row, x) for x in range(k, k + size)}
    return out, words


def test_repeats_equal_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghi", k=6))
    some = lambda n: [word() + rng.choice(["", "", ".", "\n"]) for _ in range(n)]
    passages = [some(rng.randint(linededup.WINDOW, 90)) for _ in range(6)] + [some(30) for _ in range(3)]
    texts = [None, "", "a " * 5]
    for k in range(40):
        parts = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            parts += [*rng.choice(passages), *some(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    texts += texts[5:8]
    want, words = _gone(texts, 8)
    out = {r.doc_id: r for r in linededup.dedup_units(table(spark, list(enumerate(texts)))).collect()}
    for row, t in enumerate(texts):
        spans = [tuple(map(int, s.split(":"))) for s in (out[row].spans or "").split(",") if s]
        got = {k for k, (a, b) in enumerate(words[row]) if any(x <= a and b <= y for x, y in spans)}
        assert got == {k for r, k in want if r == row}, row
        assert out[row].kept_text == (None if t is None else linededup.cut(t, spans)) and out[row].n_removed == len(spans)


# ---- near-duplicates


def _grams(text, n=5):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\t-\r ]+", text)]
    return collections.Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else collections.Counter()


def _classes(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("floor", [0.8, 0.3])
def test_weighted_similarity_links_as_brute_force_does(spark, floor):
    rng = random.Random(int(floor * 10))
    words = ["w%d" % k for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(14)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for share in (0.01, 0.02, 0.03, 0.06, 0.2):
            texts.append(" ".join(x if rng.random() > share else "new%d" % rng.randint(0, 9999) for x in b))
    settings = minhash.Settings(plain=False, floor=floor, agree=0.0, block=16)
    classes, links = minhash.near_duplicates(table(spark, list(enumerate(texts))), settings)
    counts = [_grams(t) for t in texts]
    df, n = collections.Counter(g for c in counts for g in c), len(texts)
    idf = lambda g: floor + (1 - floor) * math.log((1 + n) / (1 + df[g])) / math.log(1 + n)
    weighed = [{g: (1 + math.log(m)) * idf(g) for g, m in c.items()} for c in counts]

    def similar(a, b):
        both = sum(min(x, weighed[b][g]) for g, x in weighed[a].items() if g in weighed[b])
        return both / (sum(weighed[a].values()) + sum(weighed[b].values()) - both)

    sims = {(a, b): similar(a, b) for a, b in itertools.combinations(range(n), 2)}
    assert not [p for p, s in sims.items() if abs(s - 0.8) < 1e-4]
    got = {r.doc_id: r.class_id for r in classes.collect()}
    assert [got[k] for k in range(n)] == _classes(n, [p for p, s in sims.items() if s >= 0.8])
    assert all(r.similarity >= 0.8 for r in links.collect())


def test_near_copies_of_the_table_are_found(spark):
    """Of all pairs of different texts with a plain similarity of 0.8 or more, at least 0.95 are of one class; so are all equal texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in catalogue.op3_minhash(spark, SF).collect()}
    sets, holders = {r.doc_id: set(_grams(r.text or "")) for r in rows}, collections.defaultdict(list)
    shared = collections.Counter()
    for k, s in sets.items():
        for g in s:
            shared.update((j, k) for j in holders[g])
            holders[g].append(k)
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    found = sum(got[a] == got[b] for a, b in near)
    assert len(near) > 20 and found >= 0.95 * len(near)
    equal = collections.defaultdict(set)
    for r in rows:
        equal[r.text].add(got[r.doc_id])
    assert all(len(x) == 1 for t, x in equal.items() if t is not None)
    # and no class joins texts that have next to nothing in common with any other of it
    for members in itertools.groupby(sorted(got, key=got.get), key=got.get):
        group = list(members[1])
        assert len(group) == 1 or all(any(len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) for b in group if b != a) for a in group)


# ---- chat


def _ordered(messages):
    """(after_turn, depth, status) of messages (conv_id, turn, role, text) of one conversation, by the definitions of chat.topological."""
    late = lambda t: math.inf if t is None else t
    held = [json.loads(t) if t and t.startswith("{") else {} for _, _, _, t in messages]
    calls = [(k, c.get("id"), c.get("arguments")) for k, h in enumerate(held) for c in h.get("tool_calls", [])]
    by_id = collections.defaultdict(set)
    for k, ident, _ in calls:
        by_id[ident].add(k)

    def link(k, ident):
        found = by_id.get(ident, ())
        before = [x for x in found if late(messages[x][1]) < late(messages[k][1])]
        return max(before, key=lambda x: late(messages[x][1])) if before else min(found, key=lambda x: late(messages[x][1])) if found else None

    answers = {k: link(k, h["tool_call_id"]) for k, h in enumerate(held) if "tool_call_id" in h}
    waits = collections.defaultdict(set)
    for k, _, arguments in calls:
        for value in (arguments or {}).values():
            if isinstance(value, str) and (found := link(k, value)) is not None:
                waits[k] |= {found} | {r for r, c in answers.items() if c == found and held[r]["tool_call_id"] == value}
    told, is_call = {}, {k for k, _, _ in calls}
    for k, c in answers.items():
        if c is not None and k in is_call:
            waits[k].add(c)
    open_ = set(range(len(messages)))
    while True:
        ready = {k for k in open_ if all(x not in open_ for x in waits[k]) and (k in is_call or answers.get(k) is None or answers[k] not in open_)}
        if not ready:
            break
        for k in ready:
            turn = late(messages[k][1])
            if k not in is_call and answers.get(k) is not None:
                after, depth = told[answers[k]][0], told[answers[k]][1] + 1
            else:
                least = max((told[x][:2] for x in waits[k]), default=(-1, 0))
                after, depth = (turn, 0) if turn > least[0] else (least[0], least[1] + 1)
            told[k] = after, depth, "call" if k in is_call else "plain" if k not in answers else "orphan" if answers[k] is None else "result"
        open_ -= ready
    for k in open_:
        told[k] = late(messages[k][1]), 0, "cycle"
    return [told[k] for k in range(len(messages))]


def test_tool_calls_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(25):
        for turn in rng.sample(range(20), rng.randint(1, 9)):
            ids = [f"c{rng.randint(0, 5)}" for _ in range(rng.randint(1, 2))]
            call = {"tool_calls": [{"id": i, "name": "search", "arguments": {"query": rng.choice(["x", f"c{rng.randint(0, 6)}"])}} for i in dict.fromkeys(ids)]}
            answer = {"tool_call_id": f"c{rng.randint(0, 7)}", "content": "é"}
            text = rng.choice([json.dumps(call), json.dumps(call), json.dumps(answer), json.dumps(answer), "said", None, json.dumps(call | answer)])
            rows.append((conv, None if rng.random() < 0.05 and not any(r[0] == conv and r[1] is None for r in rows) else turn, "assistant", text))
    out = chat.link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame(catalogue.TOOLS, chat.SCHEMA)).collect()
    got = {(r.conv_id, r.turn): r for r in out}
    statuses = collections.Counter()
    for conv in range(25):
        mine = [r for r in rows if r[0] == conv]
        for m, (after, depth, status) in zip(mine, _ordered(mine), strict=True):
            r = got[m[0], m[1]]
            statuses[status] += 1
            assert (math.inf if r.after_turn is None else r.after_turn, r.depth, r.status) == (after, depth, status), (m, r)
        places = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in places] == list(range(len(mine)))
        order = [(math.inf if r.after_turn is None else r.after_turn, r.depth, math.inf if r.turn is None else r.turn) for r in places]
        assert order == sorted(order)
    assert set(statuses) == {"call", "result", "orphan", "plain", "cycle"}


# ---- secrets


def _cheapest(cost, value):
    """The least cost over every way to cut a value, pieces judged by their definitions."""
    low, near, step = value.lower(), secrets._NEAR, math.log10(2)
    leet = low.translate(secrets._LEET)
    date = re.compile(r"(19|20)\d\d([-/._]?(0[1-9]|1[0-2])[-/._]?(0[1-9]|[12]\d|3[01]))?|(0[1-9]|[12]\d|3[01])[-/._]?(0[1-9]|1[0-2])[-/._]?(19|20)\d\d", re.ASCII)

    def piece(i, j, repeats):
        v, costs = low[i:j], [sum(map(secrets._brute, value[i:j]))]
        n = j - i
        if n >= 3:
            for word, extra in ((v, 0.0), (leet[i:j], 0.5)):
                if word in cost.rank:
                    costs.append(math.log10(cost.rank[word] + 1) + extra + 0.3 * (value[i:j] != v))
            if all(b in near.get(a, ()) for a, b in itertools.pairwise(v)):
                costs.append(1.7 + math.log10(n) + 0.2 * n)
            if all(abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum() for a, b in itertools.pairwise(v)):
                costs.append(1.4 + math.log10(n) + 0.2 * n)
        if repeats:
            if date.fullmatch(value[i:j]):
                costs.append(math.log10(365 * 119 if n > 4 else 365))
            for size in range(1, min(8, n // 2) + 1):
                if n >= 3 and n % size == 0 and value[i : i + size] * (n // size) == value[i:j]:
                    costs.append(least(i, i + size, False) + math.log10(n // size))
        return min(costs)

    def least(a, b, repeats=True):
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=b - a - 1):
            edges = [a, *(a + k + 1 for k, c in enumerate(cuts) if c), b]
            best = min(best, sum(piece(i, j, repeats) for i, j in itertools.pairwise(edges)) + step * (len(edges) - 2))
        return best

    return least(0, len(value)) if value else 0.0


def test_guess_cost_is_the_least_of_all_segmentations():
    cost, rng = secrets.GuessCost((*secrets.COMMON, "horse", "battery")), random.Random(4)
    pieces = ["a", "ab", "12", "abc", "qwe", "pa55", "Key", "1999", "0112", "31", "horse", "zz", "!", "é", "-"]
    for _ in range(120):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4)))[:9]
        assert cost.log10(value) == pytest.approx(_cheapest(cost, value), abs=1e-9), value


def test_words_are_learned_from_the_documents(spark):
    texts = ["configuration international " * 5, "Configuration x1 été " * 4, None, "", "rare", "ab " * 9]
    assert secrets.learn_words(table(spark, list(enumerate(texts)))) == ("configuration", "international", "été")
    assert secrets.learn_words(table(spark, list(enumerate(texts))), keep=1) == ("configuration",)
    assert secrets.learn_words(table(spark, [])) == ()
    line = "secret: configuration-international"
    plain, learned = secrets.GuessCost(()), secrets.GuessCost(("configuration", "international"))
    assert secrets.guess_spans(line, plain) and not secrets.guess_spans(line, learned)
    spans = [r.spans for r in secrets.scan_secrets(table(spark, [(0, line), (1, "configuration international " * 3)])).collect()]
    assert "guess" not in spans[0]
    assert [r.c for r in table(spark, [(0, None)]).select(F.lit(1).alias("c")).collect()] == [1]
