"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from tests.llm.conftest import BASE
from traceframe.llm import ann, decontamination, language, line_dedup, near_dedup, packing, quality, registry, secrets, token_files
from traceframe.llm.tokens import TextEncoder, public_path
from traceframe.plans.scratch import materialize, scratch_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\n"), (4, "é ü 中 😀"), (5, "a " * 30_000), (6, BASE), (6, BASE), (7, BASE), (None, "no id here at all today")]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, SF, registry.QUERIES[name], registry.ORACLES[name]) == ""


def test_pieces_are_encoded_like_whole_texts():
    random.seed(1)
    parts = [" ", "  ", "\n", " \n", "\t", "The", "it's", "1", " ", "é", "Σ", "<|endoftext|>", "!?", "\x1c", "中", "😀", "\r\n", "a.", "É,", "µ.", "Straße"]
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = TextEncoder(public_path(file))
        texts = ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(3_000)]
        for text, got in zip(texts, enc.encode(texts), strict=True):
            ids = enc.tokenizer.encode(text, add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_packing(docs):
    path = public_path("byte_bpe_50k.json")
    enc = TextEncoder(path)
    rows = packing.pack(docs(ODD, length=3, ids="x"), path).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    for doc, text in {(i, t) for i, t in ODD if i not in (6, None)}:
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == enc.encode([text])[0] + struct.pack("<I", 1)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
    assert packing.pack(docs([]), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs([]), path, longest=1000)


def test_buckets_hold_equal_lengths(spark, docs):
    packed = materialize(packing.pack(docs(ODD), public_path("byte_bpe_50k.json")), "packed")
    path = scratch_path(spark, "buckets")
    packing.write_buckets(packed, path)
    back = spark.read.parquet(path)
    assert back.filter("length <> shiftleft(1, bucket)").count() == 0 and back.select("bucket").distinct().count() > 3
    assert sorted((r.sequence_id, r.length) for r in back.collect()) == sorted((r.sequence_id, r.length) for r in packed.collect())


def test_token_files(spark, docs):
    file = public_path("word_bpe_49k.json")
    enc = TextEncoder(file)
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, f"text number {i} with a few words") for i in range(300)]
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs(rows, n_tokens=1, frame="x"), file, path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        want = enc.encode([dict(rows)[r.doc_id]])[0] + struct.pack("<I", 2)
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (at, len(want) // 4, want, zlib.crc32(want))
        at += r.n_tokens
    one = token_files.read_tokens(spark, path, 150).collect()
    assert len(one) == 1 and one[0].start == next(r.start for r in got if r.doc_id == 150)
    empty = scratch_path(spark, "tokens")
    token_files.write_tokens(docs([]), file, empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_language(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(d.filter("doc_id % 5 <> 0"))
    right = language.identify(d.filter("doc_id % 5 = 0"), model).join(d, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    en, de = (d.filter(f"lang = '{x}' and n_chars > 400").first().text[:300] for x in ("en", "de"))
    lang, score, spans = language.label_texts(model, [f"{en}\n{de}"])[0]
    assert [s[2] for s in spans] == ["en", "de"] and 0.4 < score < 0.6 and lang in ("en", "de")
    odd = {r.doc_id: r for r in language.identify(docs(ODD, score=1, id=3), model).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[1].score == 0
    assert language.identify(docs([]), model).count() == 0
    nothing = language.train(docs([(1, "a b")]).filter("false"))
    assert language.identify(docs([(1, "a b")]), nothing).first().lang_pred == "und"


def _viterbi_slow(score):
    best = [list(score[0])]
    back = []
    for row in score[1:]:
        top = max(range(len(row)), key=lambda k: best[-1][k])
        change = best[-1][top] - language.SWITCH
        back.append([k if best[-1][k] >= change else top for k in range(len(row))])
        best.append([max(best[-1][k], change) + row[k] for k in range(len(row))])
    out = [int(np.argmax(best[-1]))]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1]


def test_viterbi():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 9, 3])
    score = rng.normal(0, 9, (sizes.sum(), 4))
    got, at = language._viterbi(score, sizes), 0
    for n in sizes:
        if n:
            assert got[at : at + n].tolist() == _viterbi_slow(score[at : at + n])
        at += n


def test_secrets(docs):
    key = "AKIA" + "Q7" * 8
    rows = [(1, f"é token: abcdef123456 and {key}."), (2, "password=secret=short token=abc"), (3, "deadbeefdeadbeef12 0123456789abcde"), (4, "API_KEY = 'Zz9/+=aaaaaaaa'"), *[(10 + i, t) for i, (_, t) in enumerate(ODD)]]
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows += [(100 + i, "see " + "".join(rng.choices(alphabet, k=64)) + " end") for i in range(20)]
    rows += [(200 + i, "see version_2024_of_the_long_identifier_name_" + "x" * i) for i in range(20)]
    got = {r.doc_id: r for r in secrets.scan(docs(rows, spans="x", base=1)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got[1].s == f"assign:2:21,access:26:{26 + len(key)}"
    assert got[2].s == "assign:0:21" and got[4].s == f"assign:0:{len(rows[3][1]) - 1}"
    assert got[3].s == "hex:0:18"
    found = [bool(re.search("random", got[100 + i].s)) for i in range(20)]
    assert sum(found) >= 18 and not any("random" in got[200 + i].s for i in range(20))
    assert got[10].s == got[11].s == "" and secrets.scan(docs([])).count() == 0


def test_secrets_behind_an_equals_sign(docs):
    rng = random.Random(9)
    token = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=64))
    before = ["AWS_SECRET_ACCESS_KEY=", "see https://a.com/b?sig=", "export X=", "see "]
    rows = [(10 * k + i, lead + token() + " end") for k, lead in enumerate(before) for i in range(10)]
    rows.append((90, "name=version_2024_of_the_long_identifier_name_here"))
    got = {r.doc_id: r.s for r in secrets.scan(docs(rows)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    for k, lead in enumerate(before):
        assert sum(got[10 * k + i] == f"random:{len(lead)}:{len(lead) + 64}" for i in range(10)) >= 9
    assert got[90] == ""


def _sets(rows):
    out = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        out[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return out


def _components(rows, similarity=85):
    """Brute force: doc_id to (sizes of its sets, smallest doc_id reachable); texts of one id hang together."""
    sets = [(i, s) for i, t in rows for s in [_sets([(i, t)])[i]]]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i != j and a and b and 100 * len(a & b) >= similarity * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {(i, len(s)): find(i) for i, s in sets}


def _edited(rng, words, groups, copies, edits):
    out = []
    for g in range(groups):
        base = rng.choices(words, k=rng.randint(40, 200))
        for k in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((1000 + 100 * g + rng.randrange(10_000) * 10_000 + k, " ".join(copy)))
    return out


def test_near_dedup(docs, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in ODD if i is not None and i != 6] + [(6, BASE)] + _edited(rng, words, 12, 25, 5)
    want = _components(rows)
    result = lambda rows: {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.find_components(docs(rows, node=1, sig="x")).collect()}
    assert result(rows) == {key: (c, c == key[0]) for key, c in want.items()}
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 4)  # groups in many blocks
    assert result(rows) == {key: (c, c == key[0]) for key, c in want.items()}
    assert near_dedup.find_components(docs([])).count() == 0


def test_near_dedup_links_the_texts_of_one_id(docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (12, c), (7, c)]
    got = {(r.doc_id, r.component_id) for r in near_dedup.find_components(docs(rows)).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (7, 7), (12, 7)}


def test_merge_block_against_all_pairs():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 2**63, 120, np.uint64))
    grams = []
    for i in range(60):
        keep = base if i < 2 else base[rng.random(120) > rng.choice([0.02, 0.06, 0.1])]
        grams.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 6), np.uint64)])))
    sig = np.stack([near_dedup.signature(g) for g in grams])
    ids, n, own = np.arange(60), np.array([len(g) for g in grams]), np.zeros(60, np.int64)
    for side in (np.zeros(60, int), np.arange(60) % 2):
        links = near_dedup.merge_block(ids, ids // 3, n, own, sig, grams, side, near_dedup.MATCHES, 85)
        label = {i: i // 3 for i in range(60)}

        def joined(pairs, label=label):
            own = dict(label)
            for i, j in pairs:
                own = {k: own[i] if v == own[j] else v for k, v in own.items()}
            return {frozenset(k for k in own if own[k] == v) for v in own.values()}

        both = len(set(side)) > 1
        every = [(i, j) for i in range(60) for j in range(i) if near_dedup.similar(grams[i], grams[j], 85) and not (both and side[i] == side[j])]
        assert joined(links) == joined(every) and len(links) < 60 and len(every) > len(links)


def test_line_dedup_and_decontamination_on_odd_texts(spark, docs):
    lines = "\n".join(f"line {i} has five words and more" for i in range(3))
    rows = [*ODD, (20, lines), (21, lines), (22, "line 1 has six words and more\nshort one"), (23, None)]
    out = line_dedup.dedup_lines(docs(rows, line_no=1, place="x", key="k"))
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got[21] == ("", 3) and got[20][1] == 2 and got[22] == ("short one", 1) and out.filter("doc_id = 6").count() == 1 and got[1] == (None, 0) and got[7] == ("", 1)
    assert out.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "line_no", "place", "key"] and line_dedup.dedup_lines(docs([])).count() == 0
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 34))), (2, "no ID"), (3, None), (4, "")], "item_id long, text string")
    found = decontamination.decontaminate(docs(rows, items=1, h="x"), items)
    by = {(r.doc_id, r.n_words): (r.n_hit, r.items, r.contaminated) for r in found.collect()}
    assert by[7, 60] == (14, ["1"], True) and by[None, 6] == (2, ["2"], True) and by[1, 0] == (0, [], False)
    assert found.count() == len(rows) and decontamination.decontaminate(docs([]), items).count() == 0


@pytest.mark.parametrize("listed", [10_000, 1])
def test_decontamination_against_brute_force(spark, docs, monkeypatch, listed):
    monkeypatch.setattr(decontamination, "FIRST_WORDS", listed)
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "B", "c", "dd", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 7, 9, 10, 11, 14])))) for i in range(2, 40)] + [(1, None), (0, "..."), (None, "b b")]
    rows = [(i, "; ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(70, items[0][1]), (70, items[0][1]), (71, None)]
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    want = set()
    for i, text in rows:
        words, hit, found = split(text), set(), set()
        for item, t in items:
            w = split(t)
            n = min(len(w), 10)
            for k in range(len(w) - n + 1 if w else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add("" if item is None else str(item))
        want.add((i, len(words), tuple(sorted(hit)), tuple(sorted(found))))
    df, bench = docs(rows, row=1, row_a=2, h="x", needle=3), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(df, bench).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_words, tuple(r.hit_words or []), tuple(r.items)) for r in got} == want
    clean = decontamination.drop_contaminated(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, h, _ in want if not h)


def _edits_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _deduped(rows):
    """Brute force: text and number of removed lines by (doc_id, text)."""
    kinds = lambda x: x.split(" ") if len(x.split(" ")) >= line_dedup.MIN_WORDS else list(x) if len(x) >= line_dedup.MIN_CHARS else None
    seen, out = [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        if not text:
            out[i, text] = (text, 0)
            continue
        kept, gone = [], 0
        for raw in text.split("\n"):
            line = raw.strip(" ")
            units = kinds(line)
            words = len(line.split(" ")) >= line_dedup.MIN_WORDS
            near = units is not None and any(w == words and u is not None and _edits_at_most_one(units, u) for _, u, w in seen)
            if line and (near or any(line == x for x, _, _ in seen)):
                gone += 1
            else:
                kept.append(raw)
            if line:
                seen.append((line, units, words))
        out[i, text] = ("\n".join(kept), gone)
    return out


def test_line_dedup_against_brute_force(docs, tmp_path, spark):
    rng = random.Random(3)
    rows = list(enumerate(["z b c d e f", "a b c d e f", "b c d e f g", "b c d e f h"]))
    for i in range(60):
        lines = [" ".join(rng.choices("xyz", k=rng.randint(1, 8))) if rng.random() < 0.6 else "".join(rng.choices("ab ", k=rng.randint(0, 13))) for _ in range(4)]
        rows.append((10 + i, "\n".join(lines)))
    rows += [rows[5], rows[6], (100, "中文没有空格的一行文字"), (101, "中文没有空格的一个文字"), (102, ""), (102, ""), (103, None), (104, "} \n}")]
    rows += [(105, "an old man\n"), (106, " an old man"), (107, "anold manxyz"), (108, "an oldd man\nan old men")]
    made = docs(rows, line_no=1, place="x", key="k", _cut="c", cut="d", row="r", text_a=5, doc="z", lines="l")
    got = {}
    for r in line_dedup.dedup_lines(made).collect():
        key = next(k for k in rows if k[0] == r.doc_id)
        assert key not in got or key == (102, "")
        got[key] = (r.text, r.n_removed)
        assert (r.line_no, r._cut, r.cut, r.row, r.text_a, r.lines) == (1, "c", "d", "r", 5, "l")
    assert got == _deduped(rows)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, str(tmp_path), line_dedup.op7_line_dedup, line_dedup.ORACLE) == ""


def test_line_dedup_of_texts_that_share_an_id(docs):
    one, two = "the first line of it\nthe shared line of both of them", "another line of the second\nthe shared line of both of them"
    for rows in ([(1, one), (1, two)], [(None, one), (None, two)]):
        got = sorted((r.text, r.n_removed) for r in line_dedup.dedup_lines(docs(rows)).collect())
        assert sum(n for _, n in got) == 1 and "\n".join(t for t, _ in got).count("shared") == 1


def test_line_dedup_of_very_long_lines(docs):
    words = [f"w{i % 977 * i}" for i in range(60_000)]
    changed, longer = list(words), list(words)
    changed[100] = "zz"
    longer.insert(40_000, "q")
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(longer)), (4, " ".join(reversed(words)))]
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs(rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_quality(spark, docs):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    graded = quality.grades(labels)
    model = quality.train(d, graded.filter("doc_id % 5 <> 0"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    rated = quality.rate(d, model).join(graded.filter("doc_id % 5 = 0"), "doc_id").select(((F.col("p_top") >= 0.5) == (F.col("grade") == 2)).cast("int").alias("ok"))
    assert rated.agg(F.avg("ok")).first()[0] > 0.9
    assert quality.rate(docs(ODD, p_top=1), model).count() == len(ODD) and quality.select(docs([]), model).count() == 0
    blank = quality.train(docs([(1, "a")]), graded.filter("false"))
    assert quality.select(docs(ODD), blank).count() == len(ODD)
