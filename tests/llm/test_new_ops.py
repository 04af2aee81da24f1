"""Fill-in-middle, turn repair and toxicity against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from habitrace.llm import fill_middle, queries, toxicity, turn_repair

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# Fill-in-middle
def _cut(doc_id, text):
    """(n, form, prefix, middle, output) by the contract, lines by Python's own regular expressions."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = [None, "", "\n", "\n\n\n", "one", "one\n", "\none", "a\r\nb\r\n", "é\n😀\nß\n", "x <P> y\nz", "<\n<S\nS>\n", "ends <", "<M\n>", " a\x0bb\n", "\x00\n\x00", "no line " * 30000, "l\n" * 20000]


def test_fill_middle(spark):
    rows = [(i if i != 5 else None, t, "clash", "clash") for i, t in enumerate(LINES * 6)] + [(1, "one\ntwo", "c", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, form string")
    made = fill_middle.fill_in_middle(docs)
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted(((r[0], *_cut(r[0], r[1])) for r in rows), key=str)
    digests = sorted(map(tuple, fill_middle.with_digests(made).collect()), key=str)
    assert digests == sorted(((i, *_cut(i, t)[:4], sha(_cut(i, t)[4]), sha(t or "")) for i, t, *_ in rows), key=str)
    assert fill_middle.with_digests(fill_middle.fill_in_middle(docs.limit(0))).count() == 0
    assert {r.form for r in fill_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_op11(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op11_fill_middle"](spark, SF).collect()}
    assert got == {i: (*_cut(i, t)[:4], sha(_cut(i, t)[4]), sha(t or "")) for i, t in docs.items()}


# Turn repair
def _faults(turns):
    """(initial, fault) of ordered (turn, role, text)."""
    seen, found = set(), []
    for _, role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role[:1], fault))
    return found


def _walk(turns):
    """(cost, audit) by a plain walk over all ways to edit, state by state."""
    after = {(None, "s"): "s", (None, "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(4):
            for (state, new), to in after.items():
                if new != "s" and state in best:
                    way = (best[state][0] + 3, best[state][1] + "I")
                    best[to] = min(best.get(to, way), way)
        return best

    best = inserted({None: (0, "")})
    for initial, fault in _faults(turns):
        ways = {s: [(c + 4, a + "D")] for s, (c, a) in best.items()}
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            for (state, new), to in after.items():
                if state in best:
                    c, a = best[state]
                    if new == initial:
                        ways.setdefault(to, []).append((c + extra, a + "K"))
                    if new != "s":
                        ways.setdefault(to, []).append((c + extra + 3, a + "R"))
        best = inserted({s: min(w) for s, w in ways.items()})
    return min(best[s] for s in (None, "a") if s in best)


def _every_edit(turns, most=3):
    """(cost, audit) over literally every audit with at most ``most`` insertions at a place."""
    cells = []
    for initial, fault in _faults(turns):
        extra = 3 * (fault == "truncated")
        cells.append([(4, "D", "")] if fault in ("blank", "duplicate") else [(4, "D", ""), (extra, "K", initial or "?"), (extra + 3, "R", "u"), (extra + 3, "R", "a")])
    gap = [(3 * k, "I" * k, "".join(r)) for k in range(most) for r in itertools.product("ua", repeat=k)]
    found = []
    for ways in itertools.product(*[x for c in cells for x in (gap, c)], gap):
        if re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in ways)):
            found.append((sum(w[0] for w in ways), "".join(w[1] for w in ways)))
    return min(found)


def _repaired(turns, audit):
    """The lines that an audit leaves."""
    kept, left = [], list(turns)
    for edit in audit:
        turn = None if edit == "I" else left.pop(0)
        if edit != "D":
            kept.append((turn, edit))
    lines = []
    for k, (turn, edit) in enumerate(kept):
        role = turn[1] if edit == "K" else ("assistant", "user")[(len(kept) - 1 - k) % 2]
        lines.append(f"{role}:{turn[2] if turn else ''}")
    return "\n".join(lines)


def _expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults = _faults(turns)
    numbers = [t[0] for t in turns if t[0] is not None]
    cost, audit = _walk(turns)
    count = lambda f: sum(x[1] == f for x in faults)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha(_repaired(turns, audit))


def _damage(conv, turn, role, text):
    of = lambda v: " " if v is None else str(v)
    way, role, text = zlib.crc32(f"{of(conv)}:{of(turn)}".encode()) % 20, of(role), of(text)
    if way == 0:
        return []
    text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
    return [(turn, "user" if way == 4 else role, text)] * (1 + (way == 3))


def _turns(rng, n):
    texts = ["Hi.", "Yes!", "and then", " \t\n", "", "Hi.", "ok?  ", "a.\x85"]
    return [(rng.choice([None, k, k, k, k + 1]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ümlaut"]), rng.choice(texts) + (str(k) + "." if rng.random() < 0.6 else "")) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_walk_is_every_edit(n):
    rng = random.Random(n)
    for _ in range(25):
        turns = _turns(rng, n)
        assert _walk(turns) == _every_edit(turns)


def test_products_associate():
    rng = random.Random(3)
    for _ in range(60):
        turns = [(i, f, rng.choice([1, 1, 3])) for i, f in _faults(_turns(rng, 12))]
        at, of = sorted(rng.sample(range(1, 12), 2)), turn_repair.product
        a, b, c = of(turns[: at[0]]), of(turns[at[0] : at[1]]), of(turns[at[1] :])
        assert turn_repair.times(turn_repair.times(a, b), c) == turn_repair.times(a, turn_repair.times(b, c)) == of(turns)


def test_repair(spark):
    rng = random.Random(11)
    made = {c: _turns(rng, n) for c, n in enumerate([1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 8, 9, 12, 20, 300])} | {None: _turns(rng, 5), -3: [(1, "user", "Hi.")] * 4 + [(None, "user", "Hi.")] * 2}
    # across several blocks, and across many groups of blocks when a block is small
    made[99] = [(k, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"turn {k}."])) for k in range(1500)]
    rows = [(c, t, r, x, 1, "clash") for c, turns in made.items() for t, r, x in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long, audit string")
    ids = frame.select("conv_id").union(spark.createDataFrame([(77,)], "conv_id long"))
    want = {c: _expected(t) for c, t in made.items()} | {77: (0, 0, 0, 0, 0, 0, "", sha(""))}
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(frame, ids).collect()} == want


def test_many_levels(spark, monkeypatch):
    """Blocks of four rows in groups of two: matrices meet over ten levels."""
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(turn_repair, "GROUP", 2)
    rng = random.Random(5)
    turns = [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"turn {k}.", f"cut {k}"])) for k in range(700)]
    frame = spark.createDataFrame([(4, *t, 1) for t in turns], "conv_id long, turn long, role string, text string, copies long")
    assert [tuple(r)[1:] for r in turn_repair.repair(frame, frame).collect()] == [_expected(turns)]


def test_damage_of_odd_rows(spark):
    rows = [(c, t, r, x) for c in (None, *range(12)) for t in (None, 0, 1, 2, 3, 5) for r, x in (("user", "Hi. You?"), (None, "Yes."), ("assistant", None))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, *rest in rows:
        want.setdefault(c, []).extend(_damage(c, *rest))
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damaged(frame), frame).collect()} == {c: _expected(t) for c, t in want.items()}
    assert turn_repair.repair(turn_repair.damaged(frame.limit(0)), frame.limit(0)).count() == 0


def test_op12(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        want.setdefault(r.conv_id, []).extend(_damage(*r))
    assert {r.conv_id: tuple(r)[1:] for r in queries.queries()["op12_turn_repair"](spark, SF).collect()} == {c: _expected(t) for c, t in want.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12_sql(sf):
    """The SQL against the plain walk; copies beside each other are numbered once."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '/root/testdata/{sf}/conversations.parquet'")
    want = {}
    for r in con.execute("select conv_id, turn, role, text from conversations").fetchall():
        want.setdefault(r[0], []).extend(_damage(*r))
    assert {r[0]: tuple(r[1:]) for r in con.execute(turn_repair.oracle_sql()).fetchall()} == {c: _expected(t) for c, t in want.items()}


# Toxicity
def _made(n, seed):
    """Texts whose label needs a pair: an insult beside a group; each alone is harmless."""
    rng = random.Random(seed)
    filler = [f"word{k}" for k in range(400)]
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(filler, k=rng.randint(5, 60)) + ["dolt"] * insult + ["Elves"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_of_terms(spark):
    rows = _made(1500, 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.drop("text"))
    score = lambda text: model.score(toxicity.values_of(text, model.places()))
    assert score("you dolt of the elves") > 0.9
    assert max(score("you dolt"), score("the Elves came"), score("")) < 0.1
    fresh = _made(400, 2)
    assert sum((score(t) >= 0.3) == bool(y) for _, t, y in fresh) > 395


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "you Idiot " * 5000, "z"), (2, "ünïcode\x00 words", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")):
        out = toxicity.score_documents(docs, toxicity.train(docs, labels))
        assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 4
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.collect())
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_op13(spark):
    """held_out by its rule, scores by the sum over all pairs, held-out accuracy."""
    import math

    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.queries()["op13_toxicity"](spark, sf).collect()}
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = {r.doc_id: r.text or "" for r in frame.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    caught = [got[i].predicted for i in held if labels[i]]
    flagged = [got[i].predicted for i in held if not labels[i]]
    assert sum(caught) / len(caught) > 0.93 and sum(flagged) / len(flagged) < 0.01
    model = toxicity.train(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    place = {int(t): k for k, t in enumerate(model.terms)}
    for i in sorted(docs)[:300]:
        words, x = re.findall(r"\w+", docs[i].lower()), {}
        for word in words:
            for term in toxicity.terms_of_word(word):
                if term in place:
                    x[place[term]] = x.get(place[term], 0) + 100 / len(words)
        x = {k: min(1, v) for k, v in x.items()}
        margin = model.bias + sum(model.weights[k] * v for k, v in x.items()) + sum(x[a] * x[b] * float(model.vectors[a] @ model.vectors[b]) for a, b in itertools.combinations(x, 2))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin)))


def test_training_rows_only(spark):
    """A label of a held-out row changes nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.train(docs, x, least=3.0) for x in (labels, turned))
    assert a.bias == b.bias and (a.terms == b.terms).all() and (a.weights == b.weights).all() and (a.vectors == b.vectors).all()
