import lzma
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundweave import api, cli
from soundweave.functions import distance as D
from soundweave.functions import embedding as E
from soundweave.functions import inventory as I
from soundweave.functions import phonology as P
from soundweave.functions.scoring import PRESETS, Weights, weights_of
from soundweave.operators import index as X
from soundweave.operators import phrase as H
from soundweave.operators import search as S
from soundweave.sources import dictionary, lexicon, vocabulary
from soundweave.streaming import scalars

from . import golden


@pytest.fixture(scope="session")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    assert X.build(golden.lexicon(spark), path) == 18
    return X.open_index(spark, path)


@pytest.fixture(scope="session")
def sounds(index):
    return api.Phonetics(index)


def read(spark, readings, column):
    df = spark.createDataFrame(list(enumerate(readings)), "i long, r string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("r"))).collect()]


READINGS = {"チクビ": "ch i k u b i", "ラーメン": "r a R m e N", "キッテ": "k i Q t e", "ヒョウ": "hy o u", "ファン": "f a N", "キェ": "k i e", "ヴァ": "v a", "ヲ": "o", "らーめん": "r a R m e N", "ア漢字!イ": "a i", "ヅ": "z u", "ャ": "y a", "ティー": "t i R", "": ""}


def test_phonemes(spark):
    assert read(spark, READINGS, lambda c: P.phoneme_string(P.codes(c))) == list(READINGS.values())
    assert read(spark, ["チョコビ", "ラーメン", "キッテ", "キェ"], lambda c: P.mora_count(P.codes(c))) == [3, 4, 3, 2]


def test_every_kana_has_its_codes(spark):
    assert read(spark, list(I.KANA), P.codes) == list(I.KANA_CODES.values())


def test_moras_have_parts(spark):
    (rows,) = read(spark, ["ギュンッア"], P.moras)
    assert [tuple(r) for r in rows] == [("ギュ", "gy", "u", None), ("ン", None, None, "N"), ("ッ", None, None, "Q"), ("ア", None, "a", None)]


def test_skeleton_and_ipa(spark):
    assert read(spark, ["ラーメン", "ーア", "ンー", "キッテ"], lambda c: P.vowel_skeleton(P.codes(c))) == ["aaeN", "a", "NN", "iQe"]
    assert read(spark, ["キッテ", "マッチ", "アッ", "トーキョー", "ヒト"], lambda c: P.ipa(P.codes(c))) == ["kitte", "matt͡ɕi", "aʔ", "toːkʲoː", "çito"]


def test_distances_between_phonemes():
    known = {("k", "g"): 0.14, ("k", "m"): 0.693, ("f", "p"): 0.26, ("f", "s"): 0.133, ("N", "m"): 0.35, ("R", "Q"): 0.55, ("Q", "N"): 0.6, ("a", "k"): 1.0, ("N", "k"): 1.0, ("?", "k"): 1.0}
    for (a, b), want in known.items():
        assert abs(D.phoneme_distance(a, b) - want) < 1e-3 and D.phoneme_distance(b, a) == D.phoneme_distance(a, b)
    assert D.WORST == 1.0


def slow_distance(a, b):
    a, b = [I.SYMBOL.get(c, "?") for c in a], [I.SYMBOL.get(c, "?") for c in b]
    row = [0.0]
    for y in b:
        row.append(row[-1] + D.indel_cost(y))
    for x in a:
        new = [row[0] + D.indel_cost(x)]
        for j, y in enumerate(b):
            new.append(min(row[j] + D.phoneme_distance(x, y), row[j + 1] + D.indel_cost(x), new[-1] + D.indel_cost(y)))
        row = new
    return row[-1]


def test_edit_distance_three_ways(spark):
    rng = random.Random(20260804)
    pairs = [("".join(rng.choices(I.CODES + "?", k=rng.randint(0, 11))), "".join(rng.choices(I.CODES, k=rng.randint(0, 20)))) for _ in range(300)]
    want = [slow_distance(a, b) for a, b in pairs]
    assert np.allclose(D.edit_distances(*map(list, zip(*pairs)), step=64), want)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(999, None, "a")], "i long, a string, b string")
    got = df.select("i", D.edit_distance(F.col("a"), F.col("b")).alias("x"), D.edit_distance_native(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()
    assert np.allclose([r["x"] for r in got[:-1]], want) and np.allclose([r["y"] for r in got[:-1]], want)
    assert got[-1]["x"] is None and got[-1]["y"] is None


def test_distances_over_the_cutoff_are_given_up(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices(I.CODES, k=rng.randint(0, 11))), "".join(rng.choices(I.CODES, k=rng.randint(0, 14)))) for _ in range(300)]
    want = D.edit_distances(*map(list, zip(*pairs)))
    for most in (0.0, 1.5, 4.0, 99.0):
        got = D.edit_distances(*map(list, zip(*pairs)), step=70, most=most)
        assert all(g == w if w <= most else g > most for g, w in zip(got, want))
    df = spark.createDataFrame([("kaki", "kaki"), ("kaki", "momomomo")], "a string, b string")
    assert [r[0] <= 1 for r in df.select(D.edit_distance(F.col("a"), F.col("b"), 1.0)).collect()] == [True, False]


def test_alignment_adds_up():
    rng = random.Random(3)
    for _ in range(100):
        a, b = (rng.choices(I.SYMBOLS, k=rng.randint(0, 8)) for _ in range(2))
        pairs = D.align(a, b)
        assert [p["a"] for p in pairs if p["a"]] == a and [p["b"] for p in pairs if p["b"]] == b
        code = lambda s: "".join(I.CODE[x] for x in s)
        assert abs(sum(p["distance"] for p in pairs) - slow_distance(code(a), code(b))) < 1e-9


def test_alignments_of_a_batch_are_those_of_each_pair(spark):
    rng = random.Random(8)
    pairs = [([*rng.choices(I.SYMBOLS, k=rng.randint(0, 6))], [*rng.choices(I.SYMBOLS, k=rng.randint(0, 9))]) for _ in range(60)]
    every = D.align_all(*map(list, zip(*pairs)))
    assert every == [D.align(a, b) for a, b in pairs]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(99, None, ["a"])], "i long, a array<string>, b array<string>")
    got = df.select("i", D.alignment(F.col("a"), F.col("b"), 7).alias("x")).orderBy("i").collect()
    assert [[p.asDict() for p in r["x"]] for r in got[:-1]] == every and got[-1]["x"] is None
    known = [(p["a"], p["b"], p["op"]) for p in D.align("k a N".split(), "a m i".split())]
    assert known == [("k", None, "del"), ("a", "a", "match"), ("N", "m", "sub"), (None, "i", "ins")]


def holds(query, candidate):
    """By hand: the query in one piece, specials between its phonemes skipped."""
    for start in range(len(candidate)):
        i, j = start, 0
        while i < len(candidate) and j < len(query):
            if candidate[i] == query[j]:
                j += 1
            elif not (j and candidate[i] in "RQN"):
                break
            i += 1
        if query and j == len(query):
            return len(query) / len(candidate)
    return 0.0


def test_containment(spark):
    rng = random.Random(20260813)
    pairs = [("".join(rng.choices("kaNQR", k=rng.randint(0, 4))), "".join(rng.choices("kaNQR", k=rng.randint(1, 9)))) for _ in range(500)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, q string, c string")
    got = [r[0] for r in df.orderBy("i").select(D.containment(F.col("q"), F.col("c"))).collect()]
    assert got == [holds(q, c) for q, c in pairs]


def test_published_comparison(spark):
    row = S.compare(spark.createDataFrame([("チクビ", "チョコビ")], "reading_a string, reading_b string")).first()
    assert (row["similarity"], row["distance"], row["phonetic"], row["consonant"], row["coda"], row["rhythm"], row["vowel"]) == (0.8083, 1.15, 0.9179, 1.0, 0.9428, 1.0, 0.6167)


def test_vectors():
    keys = ["Cikubi", "a", "", "raRmeN", "riNgo", "kitoku", "kutoki"]
    for space in ("phonetic", "consonant", "coda"):
        v = E.VECTORS[space](keys)
        norms = np.linalg.norm(v, axis=1)
        assert v.shape == (len(keys), E.DIMS[space]) and all(abs(n - 1) < 1e-9 or n == 0 for n in norms)
    assert not np.allclose(E.phonetic_vectors(["kitoku"]), E.phonetic_vectors(["kutoki"]))  # order matters
    v = E.phonetic_vectors(keys)
    scale = np.abs(v).max() / 127
    assert np.abs(E.quantize_array(v, scale) * scale - v).max() <= 0.02
    assert E.rhythm_vectors(["raRmeN"])[0].tolist() == [4 / 12, 0.25, 0, 0.25, 0, 1, 0, 1]


def test_weights():
    assert abs(sum(vars(weights_of("pun")).values()) - 1) < 1e-12
    with pytest.raises(ValueError):
        weights_of("nothing")
    with pytest.raises(ValueError):
        weights_of(weights=Weights())


# Known answers on the sample vocabulary.
BEST = {
    "pun": [("手首", 0.7789), ("仕組み", 0.7558), ("科学", 0.6386), ("価格", 0.6307), ("地球儀", 0.6188)],
    "rhyme": [("手首", 0.9248), ("仕組み", 0.8984), ("チョコビ", 0.7794), ("竹輪", 0.7546), ("地球儀", 0.7197)],
    "mishearing": [("仕組み", 0.8877), ("手首", 0.8687), ("チョコビ", 0.8008), ("地球儀", 0.7793), ("竹輪", 0.7687)],
}


@pytest.mark.parametrize("preset", PRESETS)
def test_search_presets(sounds, preset):
    got = sounds.similar(["チクビ"], limit=5, preset=preset).orderBy("rank").collect()
    assert [r["word"] for r in got] == [w for w, _ in BEST[preset]]
    assert all(abs(r["score"] - s) <= 2e-4 for r, (_, s) in zip(got, BEST[preset]))


def test_search_filters(sounds):
    words = lambda **how: [r["word"] for r in sounds.similar(["チクビ"], **how).orderBy("rank").collect()]
    assert words(min_mora=5, max_mora=5) == ["チョコボール"]
    assert words(categories="person, place", limit=0) and set(words(categories=["person", "place"], limit=0)) <= {"田中", "東京"}
    assert words(candidate_filter=F.col("mora_count") == 4)[0] == "地球儀"
    assert len(words(limit=0, dedupe_by_reading=False)) > len(words(limit=0))
    assert words(min_score=0.7) == ["手首", "仕組み"]
    assert S.search(sounds.index, sounds.readings(["チクビ"]), categories=[]).count() == 0
    for bad in ({"min_mora": 4, "max_mora": 3}, {"candidates": 0}, {"min_score": 2.0}, {"categories": "nobody"}, {"preset": "x"}, {"limit": -1}):
        with pytest.raises(ValueError):
            words(**bad)


def test_same_word_and_reading_are_left_out(sounds):
    got = {r["word"] for r in sounds.similar(["仕組み"], limit=0).collect()}
    assert not got & {"仕組み", "仕組", "し組み"}
    wide = {r["word"] for r in sounds.similar(["仕組み"], limit=0, exclude_same_reading=False, dedupe_by_reading=False).collect()}
    assert {"仕組", "し組み"} <= wide and "仕組み" not in wide


def test_containment_lifts_words(sounds):
    row = next(r for r in sounds.similar(["チョコ"], limit=0).collect() if r["word"] == "チョコパイ")
    assert row["containment"] == 0.5714 and row["phonetic_similarity"] == 1.0


def test_candidate_limit_and_batches(index, spark):
    asked = S.queries_of(spark, [(1, "チクビ", "チクビ"), (2, "ラメン", "らめん"), (3, "!", "!")])
    few = S.candidate_sounds(index, asked, 2, contained=False).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in few} == {1: 2, 2: 2}
    single = S.search(index, asked.where("query_id = 2"), limit=3).collect()
    assert sorted(map(str, single)) == sorted(map(str, S.search(index, asked, limit=3).where("query_id = 2").collect()))


def test_floor_holds_before_rounding(index, monkeypatch):
    asked = S.queries_of(index.lexicon.sparkSession, [(1, "チクビ", "チクビ")])
    raw = S.search(index, asked, limit=1, keep_raw=True).first()
    just = math.nextafter(raw["raw_score"], 2)  # above the best
    assert H.four(just) == raw["score"]
    assert {r["below_floor"] for r in S.search_with_floor(index, asked, min_score=just).collect()} == {True}
    assert {r["below_floor"] for r in S.search_with_floor(index, asked, min_score=raw["raw_score"]).collect()} == {False}


def test_floor_gives_way(sounds):
    rows = sounds.similar_with_floor(["チクビ", "ザザザザ"], limit=0).collect()
    flags = {r["query_id"]: r["below_floor"] for r in rows}
    assert flags == {0: False, 1: True}
    assert all(r["score"] >= 0.7 for r in rows if r["query_id"] == 0) and sum(r["query_id"] == 1 for r in rows) <= 20


def test_index_round_trip(index, spark, tmp_path):
    assert index.meta["count"] == 18 and index.groups.count() == 16
    assert {r["category"]: r["words"] for r in X.category_counts(index.lexicon).collect()} == {"common": 13, "product": 3, "place": 1, "person": 1}
    plan = X.mora_range(index.groups, 3, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(mora_count" in plan
    with pytest.raises(ValueError):
        index.scale("rhythm")


def test_readings_of_kanji(sounds):
    got = {r["text"]: r["reading"] for r in sounds.readings(["手首と電車", "てくび", "abc", " 空 "]).collect()}
    assert got == {"手首と電車": "テクビトデンシャ", "てくび": "テクビ", "abc": "", "空": "ソラ"}


def test_normal_forms(spark):
    words = spark.createDataFrame([("引っ越し", "ヒッコシ", "引越し", 5), ("屋", "ヤ", "屋", 5), ("引", "イン", "引", 1)], "surface string, reading string, normalized string, cost int")
    texts = spark.createDataFrame([(1, "引っ越し屋さん"), (2, "ヤ"), (3, "")], "text_id long, text string")
    got = {r["text_id"]: (r["reading"], r["normalized"]) for r in S.read_texts(texts, words).collect()}
    assert got == {1: ("ヒッコシヤサン", "引越し屋さん"), 2: ("ヤ", "ヤ"), 3: ("", "")}


def check_chain(row, moras):
    at = 0
    for s in row["segments"]:
        assert s["start"] == at and s["end"] > at
        at = s["end"]
    assert at == moras and row["text"] == "".join(s["surface"] for s in row["segments"])


def test_phrases_cover_the_input(sounds):
    got = sounds.phrase(["チョコビラーメン", "ワタシノナマエハ"], limit=6).orderBy("phrase_id", "rank").collect()
    assert got[0]["text"] == "手首ラーメン"
    for r in got:
        check_chain(r, 7 if r["phrase_id"] == 0 else 8)
    own = [r for r in got if r["phrase_id"] == 0]
    assert [(-r["score"], r["segment_count"], r["text"]) for r in own] == sorted((-r["score"], r["segment_count"], r["text"]) for r in own)
    assert sounds.phrase(["ソ"], allow_particles=False).count() == 0


def test_beam_finds_the_best_chain(spark, index):
    phrases = spark.createDataFrame([(1, "チクビラメン")], "phrase_id long, reading string")
    rows = H.options(H.spans(phrases), index).toPandas()
    found = H.by_start(rows)

    def every(at):
        if at == 6:
            yield []
        for o in found.get(at, []):
            for rest in every(o.end):
                yield [o, *rest]

    best = max(sum(o.weight for o in c) / len(c) - H.SEGMENT_PENALTY * (len(c) - 1) for c in every(0))
    assert H.ranked(H.chains(found, 6, 10**6), 1)[0][1] == H.four(best)


def test_beams_double_up_to_the_widest():
    assert H.widths(24) == [24, 48, 96, 192, 384, 512] and H.widths(512) == [512] and H.widths(300) == [300, 512] and H.widths(0)[:3] == [1, 2, 4]


def slow_paths(found, length, at=0):
    if at == length:
        yield []
    for option in found.get(at, []):
        for rest in slow_paths(found, length, option.end):
            yield [option, *rest]


def test_graph_of_a_wide_beam_has_every_path(spark, index):
    phrases = spark.createDataFrame([(1, "クビソラ")], "phrase_id long, reading string")
    found = H.by_start(H.options(H.spans(phrases), index, keep=3).toPandas())
    texts = {"".join(o.surface for o in p) for p in slow_paths(found, 4)}
    assert 2 < len(texts) < H.WIDEST_BEAM
    graph = H.widest_graph(found, 4, 24, 10**6, 10**6)
    assert {p[0] for p in graph.paths} == texts and not graph.truncated
    assert {n for n, _ in graph.nodes()} == {o.node for p in slow_paths(found, 4) for o in p}
    small = H.widest_graph(found, 4, 24, 6, 2)
    assert len(small.first) <= 6 and small.truncated and small.paths[0] == graph.paths[0]


def test_chains_are_the_best_of_all_paths(spark, index):
    phrases = spark.createDataFrame([(i, r) for i, r in enumerate(["チクビソラ", "ラーメンカガク", "テンシャ"])], "phrase_id long, reading string")
    rows = H.options(H.spans(phrases), index, keep=4).toPandas()
    got = H.compose(phrases, index, limit=8, beam=10**6, keep=4).collect()
    for i, moras in ((0, 5), (1, 7), (2, 3)):
        best = {}
        for p in slow_paths(H.by_start(rows[rows["phrase_id"] == i]), moras):
            mean = sum(o.weight for o in p) / len(p)
            own = (H.four(mean - H.SEGMENT_PENALTY * (len(p) - 1)), len(p), "".join(o.surface for o in p))
            if own[2] not in best or own[0] > best[own[2]][0]:
                best[own[2]] = own
        want = sorted(best.values(), key=lambda x: (-x[0], x[1], x[2]))[:8]
        assert [(r["score"], r["segment_count"], r["text"]) for r in sorted((r for r in got if r["phrase_id"] == i), key=lambda r: r["rank"])] == want


def test_lattice_is_the_fold_of_its_paths(sounds):
    nodes, edges = sounds.lattice(["チョコビラーメン"], node_budget=20)
    n, e = nodes.collect(), edges.collect()
    assert 0 < len(n) <= 20
    names = {r["id"] for r in n}
    assert {x for r in e for x in (r["source"], r["target"]) if x} == names
    count = {r["id"]: r["path_count"] for r in n}
    for name in names:
        assert sum(r["path_count"] for r in e if r["target"] == name) == count[name] == sum(r["path_count"] for r in e if r["source"] == name)
    assert len({(r["start"], r["end"]) for r in n}) <= len(n) and max(sum((r["start"], r["end"]) == (s["start"], s["end"]) for r in n) for s in n) <= H.NODES_PER_SPAN


def test_lexicon_rules(spark):
    rows = [("1", "犬", "イヌ", "", ["名詞", "普通名詞"], 1), ("2", "犬", "イヌ", "", ["名詞", "普通名詞"], 9), ("3", "は", "ハ", "は", ["助詞"], 1), ("4", "abc", "エービー", "", ["名詞"], 1), ("5", "タナカ", "", "", ["名詞", "固有名詞", "人名"], 1), ("6", "木", "キ", "", ["名詞"], 1), ("7", "奈良", "ナラ", "", ["名詞", "固有名詞", "地名"], 1), ("8", "長", "ナガイナガイナガイナガイナガイ", "", ["名詞"], 1), ("9", "語", "go", "", ["名詞"], 1), ("a", "嗚呼", "アア", "", ["感動詞"], 1)]
    entries = spark.createDataFrame(rows, "word_id string, surface string, reading string, normalized string, pos array<string>, cost int")
    counts = spark.createDataFrame([("犬", 45), ("奈良", 0)], "surface string, documents long")
    got = {r["surface"]: r for r in lexicon.lexicon(entries, counts, 1000).collect()}
    assert set(got) == {"犬", "タナカ", "奈良", "嗚呼"}
    assert got["犬"]["cost"] == 1 and abs(got["犬"]["familiarity"] - min(1, math.log10(45001) / 4.5)) < 1e-6
    assert got["奈良"]["familiarity"] == got["タナカ"]["familiarity"] == 0.25
    assert {k: v["category"] for k, v in got.items()} == {"犬": "common", "タナカ": "person", "奈良": "place", "嗚呼": "other"}
    assert got["タナカ"]["reading"] == "タナカ" == got["タナカ"]["normalized"]
    assert lexicon.parse_categories(" common,,place ") == ["common", "place"] and lexicon.parse_categories(" , ") is None


def test_frequency_table(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("犬\t45\n[TOTAL]\t1000\n")
    counts, total = lexicon.read_frequencies(spark, str(tmp_path / "f.tsv"))
    assert total == 1000 and [tuple(r) for r in counts.collect()] == [("犬", 45)]
    (tmp_path / "f.tsv.xz").write_bytes(lzma.compress("犬\t45\n[TOTAL]\t1000\na\tb\t7\n".encode()))
    counts, total = lexicon.read_frequencies(spark, str(tmp_path / "f.tsv.xz"))
    assert total == 1000 and sorted(map(tuple, counts.collect())) == [("a\tb", 7), ("犬", 45)]
    (tmp_path / "g.tsv").write_text("犬\t45\n")
    with pytest.raises(ValueError):
        lexicon.read_frequencies(spark, str(tmp_path / "g.tsv"))


def dictionary_bytes(words, pos, shift=0):
    s = lambda t: (bytes([len(t)]) if len(t) < 128 else bytes([0x80 | len(t) >> 8, len(t) & 255])) + t.encode("utf-16-le")
    out = b"\0" * 272 + struct.pack("<H", len(pos)) + b"".join(s(x) for p in pos for x in p) + struct.pack("<hh", 2, 3) + b"\0" * 12 + struct.pack("<i", 2) + b"\0" * 8 + struct.pack("<i", 5) + b"\0" * 5
    out += struct.pack("<i", len(words)) + b"".join(struct.pack("<hhh", 1, 2, w[4]) for w in words)
    records, places = b"", []
    for surface, reading, normalized, p, _ in words:
        places.append(len(out) + 4 * len(words) + len(records) + shift)
        records += s(surface) + bytes([len(surface)] if len(surface) < 128 else [0x81, 0]) + struct.pack("<H", p) + s(normalized) + struct.pack("<i", -1) + s(reading) + b"\7\7"
    return out + b"".join(struct.pack("<i", x) for x in places) + records


def test_dictionary_file(spark, tmp_path, monkeypatch):
    pos = [["名詞", "普通名詞", "一般", "*", "*", "*"], ["助詞", "係助詞", "*", "*", "*", "*"]]
    words = [("犬", "イヌ", "", 0, 5000), ("は", "ハ", "", 1, -7), ("x" * 300, "", "y", 0, 1), ("空", "ソラ", "空", 7, 2)]
    (tmp_path / "small.dic").write_bytes(dictionary_bytes(words, pos))
    monkeypatch.setattr(dictionary, "BLOCK", 3)
    got = [tuple(r) for r in dictionary.read_dictionary(spark, str(tmp_path / "small.dic")).orderBy("word_id").collect()]
    assert got == [(f"{i:012d}", s, r or s, n or s, pos[p] if p < 2 else [], c) for i, (s, r, n, p, c) in enumerate(words)]
    with pytest.raises(ValueError):
        dictionary.layout(dictionary_bytes(words, pos, 4))


def test_functions_for_sql(spark):
    api.register(spark)
    row = spark.sql("SELECT sound_codes('らーめん') AS c, round(sound_distance('チクビ', 'チョコビ'), 4) AS d, round(sound_similarity('チクビ', 'チョコビ'), 4) AS s, sound_distance(NULL, 'ア') AS n").first()
    assert tuple(row) == ("raRmeN", 1.15, 0.8083, None)
    assert [r["op"] for r in spark.sql("SELECT * FROM sound_align('ch i k', 'ch o k u')").collect()] == ["match", "sub", "match", "ins"]


def test_json_rows(sounds):
    import json

    row = json.loads(api.as_json(sounds.similar(["チクビ"], limit=1)).first()["json"])
    assert {"word", "reading", "score", "phonetic_similarity", "embedding_similarity", "coda_similarity", "vowel_similarity", "containment", "mora_count", "category", "pos", "familiarity", "phonemes", "ipa"} <= set(row)
    pair = json.loads(api.as_json(sounds.compare([("チクビ", "チョコビ")]), "pair").first()["json"])
    assert pair["distance"] == 1.15 and pair["spaces"]["vowel"] == 0.6167 and pair["a"]["phonemes"] == ["ch", "i", "k", "u", "b", "i"]
    assert sounds.align(["k", "a"], ["g", "a"])[1] == 0.14
    assert sounds.phonemes().count() == 37 and sounds.presets().count() == 21 and sounds.info().count() > 4
    assert sounds.pronounce(["キッテ"]).first()["ipa"] == "kitte"


def test_command_line(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("1", "手首", "テクビ", "", ["名詞", "普通名詞"], 4000), ("2", "竹輪", "チクワ", "", ["名詞", "普通名詞"], 10)], "word_id string, surface string, reading string, normalized string, pos array<string>, cost int")
    rows.write.parquet(str(tmp_path / "rows"))
    at = ["--index", str(tmp_path / "index")]
    assert cli.main(["build-index", str(tmp_path / "rows"), *at], spark) == 0
    assert cli.main(["build-index", str(tmp_path / "rows"), *at], spark) == 1  # there is one
    assert cli.main(["build-index", str(tmp_path / "rows"), "--force", *at], spark) == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["index", "rows"]
    for args in (["similar", "チクビ", "--json"], ["phrase", "チクビ", "--json"], ["phrase", "チクビ", "--lattice"], ["compare", "チクビ", "チョコビ", "--json"], ["pronounce", "チクビ"], ["info"]):
        assert cli.main([*args, *at], spark) == 0
    assert "手首" in capsys.readouterr().out


def test_a_failed_build_leaves_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert X.build(vocabulary.sample(spark), path) == len(vocabulary.SAMPLE)
    broken = vocabulary.sample(spark).withColumn("surface", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        X.build(broken, path, force=True)
    with pytest.raises(FileExistsError):
        X.build(vocabulary.sample(spark), path)
    assert X.open_index(spark, path).lexicon.count() == len(vocabulary.SAMPLE) and [p.name for p in tmp_path.iterdir()] == ["index"]
    assert api.Phonetics.open(spark, path).similar(["タンポ"], limit=1).first()["word"] == "散歩"


def test_tools(sounds):
    import io
    import json

    from soundweave import mcp

    sink, number = io.StringIO(), 0

    def ask(method, **params):
        nonlocal number
        number += 1
        return json.dumps({"jsonrpc": "2.0", "id": number, "method": method, "params": params})

    def tool(name, **given):
        return ask("tools/call", name=name, arguments=given)

    asked = [
        ask("initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask("tools/list"), tool("search_phonetically", query="チクビ", limit=2), tool("search_phonetically", query="チクビ", min_mora=5, max_mora=5),
        tool("search_phonetically", query="チクビ", preset="x"), tool("search_phonetically", query="チクビ", categories=["x"]), tool("search_phonetically", query="チクビ", min_mora=4, max_mora=3), tool("compose_phrase", text="チョコビラーメン", limit=1),
        tool("compare_phonetically", a="チクビ", b="チョコビ"), tool("pronounce", text="キッテ"), tool("nothing"), tool("pronounce"), tool("pronounce", text="ア", more=1), ask("resources/list"), "{", "", ask("ping"),
    ]
    mcp.serve(lambda: sounds, io.StringIO("\n".join(asked)), sink)
    got = [json.loads(line) for line in sink.getvalue().splitlines()]
    assert len(got) == 16 and got[0]["result"]["serverInfo"]["name"] == "soundweave"
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["search_phonetically", "compose_phrase", "compare_phonetically", "pronounce"]
    texts = [json.loads(a["result"]["content"][0]["text"]) for a in got[2:10]]
    assert [r["word"] for r in texts[0]["results"]] == ["手首", "仕組み"] and texts[0]["reading"] == "チクビ" and texts[0]["scanned"] is None and texts[0]["mora_count"] == 3
    assert [r["word"] for r in texts[1]["results"]] == ["チョコボール"] and texts[1]["scanned"] == 1
    assert all("error" in t for t in texts[2:5]) and "pun" in texts[2]["available"] and "person" in texts[3]["available"] and got[4]["result"]["isError"]
    assert texts[5]["results"][0]["text"] == "手首ラーメン" and texts[6]["distance"] == 1.15 and texts[6]["spaces"]["vowel"] == 0.6167 and texts[7]["ipa"] == "kitte" and "vowel_skeleton" in texts[7]
    assert [a["error"]["code"] for a in got[10:15]] == [mcp.BAD_PARAMETERS] * 3 + [mcp.NO_METHOD, mcp.PARSE_ERROR] and got[15]["result"] == {}


def test_streams_get_the_same_values(spark, tmp_path):
    rows = spark.createDataFrame([("チョコビ",), ("ラーメン",), (None,)], "reading string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = scalars.with_similarity(scalars.with_pronunciation(stream), "チクビ").writeStream.format("memory").queryName("heard").start()
    query.processAllAvailable()
    query.stop()
    got = {r["reading"]: r for r in spark.sql("SELECT * FROM heard").collect()}
    assert got["チョコビ"]["similarity"] == 0.8083 and got["ラーメン"]["mora_count"] == 4 and got[None]["distance"] is None


def test_http_answers(sounds):
    from soundweave.server import Service

    ask = Service(sounds).respond
    status, body = ask("/api/similar", {"q": "チクビ", "limit": "2"})
    assert status == 200 and [r["word"] for r in body["results"]] == ["手首", "仕組み"] and body["query"]["mora_count"] == 3 and not body["below_floor"]
    assert ask("/api/similar", {"q": "ザザザザ"})[1]["below_floor"]
    assert [r["word"] for r in ask("/api/similar", {"q": "チクビ", "min_mora": "5", "max_mora": "5", "min_score": "0"})[1]["results"]] == ["チョコボール"]
    assert ask("/api/phrase", {"q": "チョコビラーメン", "limit": "1"})[1]["results"][0]["text"] == "手首ラーメン"
    graph = ask("/api/phrase/lattice", {"q": "チクビ"})[1]
    assert graph["nodes"] and {e["source"] for e in graph["edges"]} & {None}
    assert ask("/api/compare", {"a": "チクビ", "b": "チョコビ"})[1]["distance"] == 1.15
    assert ask("/api/align", {"a": "k a", "b": "g a"})[1]["distance"] == 0.14
    assert len(ask("/api/phonemes", {})[1]["phonemes"]) == 37 and ask("/api/info", {})[1]["count"] == "18"
    for path, given in (("/api/similar", {}), ("/api/similar", {"q": "ア", "candidates": "0"}), ("/api/similar", {"q": "ア", "limit": "-1"}), ("/api/phrase", {"q": "ア", "limit": "51"}), ("/api/similar", {"q": "ア", "min_mora": "3", "max_mora": "2"}), ("/api/similar", {"q": "ア", "categories": "x"})):
        assert ask(path, given)[0] == 400
    for path in ("/api/nothing", "/", "/api/_init__", "/api/__init__", "/api/how", "/api/read", "/api/similar/", "/api/respond"):
        assert ask(path, {"q": "ア", "x": "1"})[0] == 404


def test_pages_lose_nothing(sounds, monkeypatch):
    from soundweave import server

    every = [r["word"] for r in sounds.similar(["チクビ"], limit=0).orderBy("rank").collect()]
    monkeypatch.setattr(server, "PAGE", 5)
    got, offset, more = [], 0, True
    while more:
        status, body = server.Service(sounds).respond("/api/similar", {"q": "チクビ", "min_score": "0", "offset": str(offset)})
        got += [r["word"] for r in body["results"]]
        offset, more = offset + 5, body["more"]
    assert got == every and len(got) > 5
