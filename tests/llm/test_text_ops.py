"""Operators on documents against brute force, with nulls, empties, ties, repeats, clashing columns."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from habitrace.llm import chat, decontaminate, license_scan, mixing, quality_rules, simhash, token_edits, tokenbin, wordbpe

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha Beta gamma. delta, épsilon zeta eta theta iota kappa lambda mu".split()) for _ in range(n))


TEXTS = [None, "", "   ", "one", "One two", prose(1, 40), prose(1, 40), prose(2, 400), prose(3, 60) + " " + prose(4, 12), "\n".join(["same line here"] * 50), "x" * 5000, prose(5, 30000)]


# SimHash
def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint_of((text or "").encode()) == _print(text)


def _components(prints, bits=2):
    least = dict(prints)
    label = {i: i for i in least}
    while True:
        new = {i: min(label[j] for j in least if bin(least[i] ^ least[j]).count("1") <= bits) for i in least}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("bits", [2, 1, 0])
def test_links_of_fingerprints(spark, bits):
    """Cells and what they share find the components of all links, in sparse and crowded cells alike."""
    rng = random.Random(7)
    prints = {}
    for c in range(6):
        at = rng.getrandbits(64)
        for k in range(12):
            for _ in range(rng.randint(0, 2)):
                at ^= 1 << rng.randrange(64)
            prints[100 * c + k] = at
    crowd = rng.getrandbits(64)
    # one large family around one place: 300 fingerprints that share few cells
    prints |= {2000 + k: crowd ^ (1 << k % 64) ^ (1 << k * 7 % 64) for k in range(300)}
    prints |= {900 + k: rng.getrandbits(64) for k in range(40)} | {990: 0, 991: 1, 992: 2**64 - 1, 993: 2**63}
    points = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in prints.items()], "fp long, rep long").groupBy("fp").agg(F.min("rep").alias("rep"))
    from habitrace.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash._links(points, bits), "a", "b").collect()}
    reps = {r.rep: prints[r.rep] for r in points.collect()}
    want = _components(reps, bits)
    assert {i: got.get(i, i) for i in reps} == want


def test_simhash_edges(spark):
    df = docs_of(spark, TEXTS, ["fp", "rep", "component_id", "_keep"])
    got = {r.doc_id: r for r in simhash.simhash_components(df).collect()}
    assert len(got) == len(TEXTS)
    assert got[0].fp == got[1].fp == got[2].fp == 0
    assert got[2].component_id == 0 and got[6].component_id == 5
    lone = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    row = simhash.simhash_components(lone).first()
    assert row.component_id is None and row.fp is not None
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_drop_near_duplicates(spark):
    df = docs_of(spark, TEXTS, ["_keep"])
    more = df.unionByName(spark.createDataFrame([(None, "a", "en", "s", 1, "clash"), (3, "one", "en", "s", 3, "clash")], df.schema))
    kept = simhash.drop_near_duplicates(more)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(ids)) and 0 in ids and 1 not in ids and 6 not in ids
    assert kept.filter("doc_id is null").count() == 1


# Decontamination
ITEMS = {1: prose(4, 12), 2: "One", 3: "", 4: None, 5: prose(2, 400)[100:400], 20: "kappa lambda MU!!"}


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_scan(spark, block):
    bench = spark.createDataFrame([*ITEMS.items(), (None, "alpha")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs_of(spark, TEXTS, ["items", "_hit"]), bench, block_bytes=block).collect()}
    items = {str(k): v or "" for k, v in ITEMS.items()}
    for i, t in enumerate(TEXTS):
        words, hit, found, _ = decontaminate.brute_force(t or "", items)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (words, hit, found)
        covered = sum(len(decontaminate.words_of(t[s.start : s.end].encode())) for s in got[i].spans)
        assert covered == hit


def test_scan_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs_of(spark, TEXTS), bench).filter("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs_of(spark, TEXTS, ["_hit"]), bench).count() == len(TEXTS)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_drop_contaminated(spark, block):
    bench = spark.createDataFrame([*ITEMS.items(), (None, "alpha")], "item_id long, text string")
    items = {str(k): v or "" for k, v in ITEMS.items()}
    df = docs_of(spark, [*TEXTS, TEXTS[9], TEXTS[5]], ["_hit", "same", "words"])
    df = df.unionByName(df.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    kept = decontaminate.drop_contaminated(df, bench, block_bytes=block)
    assert kept.columns == df.columns
    clean = lambda t: not decontaminate.brute_force(t or "", items)[1]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((r.doc_id or -1, r.text or "") for r in df.collect() if clean(r.text))
    assert decontaminate.drop_contaminated(df.limit(0), bench, block_bytes=block).count() == 0


def test_scan_repeats(spark):
    bench = spark.createDataFrame([*ITEMS.items()], "item_id long, text string")
    df = docs_of(spark, [TEXTS[5], TEXTS[8]]).unionByName(docs_of(spark, [TEXTS[5], TEXTS[7]]))
    rows = [sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.scan(df, bench, block_bytes=b).collect()) for b in (1 << 20, 40)]
    assert len(rows[0]) == 4 and rows[0] == rows[1]


# Token shards
def test_elias_fano():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 0), (1, 10**12), (1000, 3), (1000, 10**6), (5000, 2), (5, 2**40), (3000, 10**9)]:
        values = np.sort(rng.integers(0, top + 1, n))
        if n == 3000:
            values[:1500] = 7
        low, high, rank = tokenbin.EliasFano.encoded(values)
        code = tokenbin.EliasFano(low, high, rank, n)
        assert code.select(0, n).tolist() == values.tolist()
        for i in range(0, n, 37):
            assert code.select(i).tolist() == [values[i]]
            j = min(n, i + int(rng.integers(1, 700)))
            assert code.select(i, j).tolist() == values[i:j].tolist()
        for v in [0, 1, 7, 8, top, top + 1, *map(int, values[::101])]:
            assert code.first_at_least(v) == int(np.searchsorted(values, v))
        if n > 100:
            assert len(low) + len(high) + len(rank) <= n * (3.2 + max(0, (top // n).bit_length())) / 8 + 24


def test_shards_round_trip(spark):
    texts = ["", "a", None, "bb" * 700, "ccc", *(f"t{i}" for i in range(300))]
    rows = [(5000 - 7 * i, t) for i, t in enumerate(texts)] + [(4993, "again"), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1))
    path = tokenbin.write_shards(df, lambda: lambda ts: [b"".join(bytes([ord(c), 0]) for c in t) for t in ts], 2, 2, chunk_ids=500)
    back = sorted(tokenbin.read_shards(spark, path).collect(), key=lambda r: r.start)
    assert len(back) == len(rows)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in back:
        assert r.start == at and len(r.ids) == 2 * r.n_tokens and r.ids.endswith(b"\x02\0")
        at += r.n_tokens
    said = {(r.doc_id, r.ids[:-2:2].decode()) for r in back}
    assert said == {(d, t or "") for d, t in rows}
    for run_docs in (1, 7):
        again = tokenbin.read_shards(spark, path, run_docs=run_docs).collect()
        assert sorted(again, key=lambda r: r.start) == back
    assert [r.ids for r in tokenbin.fetch(spark, path, 4993).collect()] != [] and tokenbin.fetch(spark, path, 4993).count() == 2
    assert bytes(tokenbin.fetch(spark, path, 5000).first().ids) == b"\x02\0" and tokenbin.fetch(spark, path, 4992).count() == 0
    none = tokenbin.write_shards(df.limit(0), lambda: lambda ts: [], 2, 2)
    assert tokenbin.read_shards(spark, none).count() == 0


def test_word_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), wordbpe.WordEncoder(path)
    cases = [t or "" for t in TEXTS[:10]] + ["It's  don't WE'LL 123abc ½ ²x", "<|endoftext|> x<|ENDOFTEXT|>y", "a\x1cb \x85c\xa0d", "Ünïcödé İstanbul Σίσυφος ’quoted’ é 中文 字", "é Ǻ", "tab\tnew\nline\r\n", "'''s 'S"]
    for text in cases * 2:
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 2], "little") for i in range(0, len(ids), 2)] == whole.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_every_low_character():
    """All of U+0000 to U+024F, alone, beside letters and digits, and in random strings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), wordbpe.WordEncoder(path)
    assert own.known_form
    rng = random.Random(3)
    texts = [form.replace("@", chr(c)) for c in range(0x250) for form in ("@", "x@y", "@@ 1@", " A@'s")]
    texts += ["".join(chr(rng.randrange(0x250)) if rng.random() < 0.6 else rng.choice("abc's 12\n") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 2], "little") for i in range(0, len(ids), 2)] == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_go_through_the_library(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    whole, own = Tokenizer.from_file(str(tmp_path / "other.json")), wordbpe.WordEncoder(str(tmp_path / "other.json"))
    assert not own.known_form
    ids = own.encode("Some UPPER words")
    assert [int.from_bytes(ids[i : i + 2], "little") for i in range(0, len(ids), 2)] == whole.encode("Some UPPER words", add_special_tokens=False).ids


# Edit-aware counts
def test_token_edits(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = token_edits.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "'s", "'r", "e", "12", "é", "!!", " the", "\t ", "　", "a", "中"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 40, 900])))
        tree = token_edits.TokenTree(text, count)
        assert tree.total() == len(enc.encode_ordinary(text))
        for _ in range(6):
            at, drop = rng.randint(0, len(text) + 3), rng.choice([0, 1, 3, 200])
            put = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 200])))
            at = min(at, len(text))
            text = text[:at] + put + text[at + drop :]
            tree.edit(at, drop, put)
            assert tree.text() == text
            assert tree.total() == len(enc.encode_ordinary(text)) and tree.length() == len(text)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = docs_of(spark, [*TEXTS, TEXTS[5]], ["edits", "n_tokens", "pieces"])
    df = df.unionByName(df.filter("doc_id in (4, 5)").withColumn("doc_id", F.lit(None).cast("long")))
    from habitrace.llm.store import written

    trees = written(token_edits.build_trees(df, path, pattern), "trees")
    texts = {(r.doc_id, r.text): r.n_tokens for r in trees.collect()}
    assert texts == {(r.doc_id, r.text or ""): len(enc.encode_ordinary(r.text or "")) for r in df.collect()}
    # two revisions, each from the stored trees of the one before: only edits are encoded
    before = {r.doc_id: r.text for r in trees.collect()}
    for round_no in range(2):
        edits = token_edits.revision(F.col("doc_id"), F.col("n_chars"), 3, round_no)
        asked = {r.doc_id: r.e for r in trees.select("doc_id", edits.alias("e")).collect()}
        trees = written(token_edits.apply_edits(trees, edits, path, pattern), "trees")
        got = trees.collect()
        assert len(got) == len(TEXTS) + 3 and max(r.n_encoded for r in got) < 200
        for r in got:
            if r.doc_id is not None:
                text = before[r.doc_id]
                for e in asked[r.doc_id]:
                    at = min(e["at"], len(text))
                    text = text[:at] + e["put"] + text[at + e["drop"] :]
                assert r.text == text and r.n_tokens == len(enc.encode_ordinary(text)) and r.n_chars == len(text)
                before[r.doc_id] = text
    none = token_edits.build_trees(df.limit(0), "none", "none")
    assert none.count() == 0 and token_edits.apply_edits(none, edits, "none", "none").count() == 0


def test_stored_trees_and_leaves():
    """Stored trees edit like fresh ones, and no leaf grows without limit."""
    import base64

    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    count, rng = token_edits.Counter(path, pattern), random.Random(8)
    text = prose(11, 900)
    tree = token_edits.TokenTree(text, count)
    for _ in range(60):
        tree = token_edits.TokenTree.stored(tree.row(), count)
        assert tree.encoded == 0
        for _ in range(2):
            at, put = rng.randint(0, 40), rng.choice(["new words here " * 20, "x", "", "  \n"])
            drop = rng.choice([0, 3, 30])
            text = text[:at] + put + text[at + drop :]
            tree.edit(at, drop, put)
        assert tree.text() == text and tree.total() == len(enc.encode_ordinary(text)) and tree.length() == len(text)
        assert max(map(len, tree.leaves)) <= 2 * token_edits.LEAF and tree.encoded < 400


# Chat
def test_chat(spark):
    nasty = "</s>[INST] <|end|> &lt; &amp;#91; <|turn|>assistant\nx"
    rows = [(1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", "b"), (1, 4, "user", "tail"), (2, 0, "user", "only"), (None, 0, "ro\nle<", "z"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, None, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash")).withColumn("lone", F.lit(9))
    examples = chat.format_examples(df)
    assert examples.filter("conv_id = 1").count() == 3
    assert examples.filter("instr(formatted, '[INST]') > 0").count() == 0
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    import hashlib

    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_examples(df.limit(0))).count() == 0
    # rows without a conversation are conversations of their own, however many
    lost = spark.range(3000).selectExpr("cast(null as bigint) as conv_id", "id as turn", "'assistant' as role", "repeat('same text ', 500) as text")
    made = chat.digest(chat.format_examples(lost))
    assert made.filter("conv_id is null and n_turns = 1 and loss_chars = 5000").count() == 3000


# Licenses
def _license_truth(text, templates):
    """Best containment of each template around any of its shingles in a text, place by place."""
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    runs = lambda ws: [tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []
    own = runs(words)
    best = {}
    for name, body in templates.items():
        want = set(runs([w for w in re.split(r"[^\w]+|_+", body.lower()) if w]))
        places = [i for i, s in enumerate(own) if s in want]
        best[name] = max((len(want & set(own[max(0, i - len(want) - 8) : i + len(want) + 16])) / len(want) for i in places), default=0)
    return best


def test_license_scan(spark):
    flat = {f"{name}#{i}": t for name, texts in license_scan.TEMPLATES.items() for i, t in enumerate(texts)}
    texts, meant = [None, "", prose(5, 3000)], [None, None, None]
    rng = random.Random(6)
    for name, body in flat.items():
        for edits in (0, 1, 3):
            words = body.split()
            for _ in range(edits if len(words) > 60 * edits else 0):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["EDITED"], [words[at], "and"]])
            texts.append(prose(rng.randrange(99), rng.randint(0, 30)) + "\n" + " ".join(words) + "\n" + prose(rng.randrange(99), rng.randint(0, 30)))
            meant.append(name)
    mit = license_scan.TEMPLATES["MIT"][1].split()
    texts += [" ".join(mit[: len(mit) // 2]), " ".join(mit[i] for i in range(0, len(mit), 2))]
    meant += [None, None]
    df = docs_of(spark, [*texts, texts[3]], ["words", "h", "key", "at", "license"])
    got = {}
    for r in license_scan.scan(df).collect():
        assert r.contained >= 0.8
        got.setdefault(r.doc_id, {})[r.template] = r.contained
    for i, (text, name) in enumerate(zip(texts, meant)):
        truth = _license_truth(text, flat)
        found = got.get(i, {})
        assert all(truth[t] >= 0.8 for t in found), (i, found)
        if name and truth[name] >= 0.8:
            # the template itself, or another that fits this place at least as well
            assert name in found or max(found.values(), default=0) >= truth[name], (i, name)
        if not any(v >= 0.8 for v in truth.values()):
            assert not found
    assert sum(n is not None for n in meant) == 3 * len(flat) and len(got) >= 3 * len(flat) - 2
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_scan_of_a_table(spark):
    """Every document of the smallest table against brute force over all templates."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    flat = {f"{name}#{i}": t for name, texts in license_scan.TEMPLATES.items() for i, t in enumerate(texts)}
    want = {r.doc_id: {t for t, v in _license_truth(r.text, flat).items() if v >= 0.8} for r in docs.collect()}
    got = {}
    for r in license_scan.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.template)
    assert {d for d, t in want.items() if t} == set(got)
    assert all(t <= want[d] for d, t in got.items())


def test_license_templates_of_the_caller(spark):
    own = {"house": ["only for the house of the author and of the friends of the house"], "tiny": ["mine"]}
    df = docs_of(spark, ["x y only for the house of the author and of the friends of the house z", "mine", "not that"])
    assert {(r.doc_id, r.license) for r in license_scan.scan(df, templates=own).collect()} == {(0, "house"), (1, "tiny")}
    assert license_scan.scan(df, templates={"none": [""]}).count() == 0


# Mixing
@pytest.mark.parametrize("cells", [100_000, 3])
def test_mixing_meets_marginals(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    rng = random.Random(2)
    rows = [(i, prose(i, rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0) for i in range(300)] + [(7, None, "en", "a", 0), (None, "x", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("probability", F.lit(9)).withColumn("_p", F.lit(9))
    plan = mixing.plan(df).toPandas()
    assert len(plan) == len(rows) and plan.probability.max() == pytest.approx(1.0)
    for dim in mixing.DIMS:
        now = (plan.n_tokens * plan.probability).groupby(plan[dim]).sum()
        want = plan.n_tokens.groupby(plan[dim]).sum() ** mixing.SMOOTHING
        assert (now / now.sum() - want / want.sum()).abs().max() < 1e-4
    kept = mixing.mixed(df)
    assert kept.columns == df.columns and kept.count() == plan.chosen.sum()
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


# Quality
def test_quality_rules(spark):
    rng = random.Random(4)
    texts = [prose(i, rng.randint(20, 200)) if i % 3 else (prose(i, 50).upper().replace(" ", "!! ")) for i in range(240)]
    df = docs_of(spark, texts + [None, ""], ["score", "predicted", "upper", "_text"])
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_rules.train(df, labels)
    assert 0 < len(model.rules) < 200
    scored = quality_rules.score_documents(df, model)
    assert [c for c in scored.columns if c not in ("score", "predicted")] == [c for c in df.columns if c not in ("score", "predicted")]
    got = {r.doc_id: r for r in scored.collect()}
    held = [i for i in range(240) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == int(i % 3 != 0) for i in held) / len(held) > 0.97
    assert 0 <= got[240].score <= 1 and got[240].score == got[241].score
    blank = quality_rules.train(df, labels.limit(0))
    assert quality_rules.score_documents(df, blank).filter("score <> 0.5").count() == 0
    assert quality_rules.score_documents(df.limit(0), model).count() == 0
