"""Each operator against brute force or a library, and on odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from slidelake.llm import bpe, common, graph, jaccard, langid, mixing, neardup, pretokens, quality, queries, sharding, tokencounts, tokenfiles, toxicity

SF = "/root/testdata/sf0.001"
HAS_DATA = Path(SF).exists()
DOC = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, JSON, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD_TEXTS = [None, "", " ", "\n\t ", "one", "a  b\n\n c ", "Ünï ςode 漢字 \U0001f600", "x" * 50_000, "word " * 3000, "a\x00b", "  \xa0.", "the same text here again", "the same text here again"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents, with nulls in every column and columns whose names clash with results."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "en", "s1", 1), (3, "\n\t ", "en", None, 1)]
    df = spark.createDataFrame(rows, DOC)
    for clash in ("n_words", "kept", "score", "size", "taken", "start", "shard", "n_tokens", "component_id", "token", "key", "w", "copies"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# Quality rules.


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b#é \x85", max_size=120))
def test_counts(text):
    assert quality.counts(text) == brute_counts(text)


def test_quality_on_odd_rows(spark, odd, nothing):
    model = quality.fit_quality(odd, labels(spark))  # no labels: all stand on the rules alone
    rows = quality.quality_rules(odd, model).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    by_text = {r.doc_id: r for r in rows}
    for i, t in enumerate(ODD_TEXTS):
        if i != 3:
            assert tuple(by_text[i][1:6]) == brute_counts(t)
    assert all(r.base_failed != r.kept for r in rows) and not by_text[0].kept
    assert quality.quality_rules(nothing, model).count() == 0
    assert quality.kept_documents(odd, model).columns == odd.columns


@pytest.mark.skipif(not HAS_DATA, reason="no tables")
def test_quality_is_calibrated(spark):
    """Over all labelled documents the mean probability is the share of good ones, and so it is, nearly, among those of about the same probability; clean documents stay."""
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.quality_rules(docs.join(known, "doc_id", "left_semi"), quality.fit_quality(docs, known)).join(known, "doc_id").select("p_quality", "quality", "kept", "base_failed").collect()
    p, y = (np.array([r[i] for r in judged]) for i in (0, 1))
    assert abs(p.mean() - y.mean()) < 0.03
    bins = np.minimum((p * 10).astype(int), 9)
    assert sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(10)) / len(p) < 0.04
    assert np.mean([r.kept for r in judged if r.quality == 1 and not r.base_failed]) > 0.99


def test_fits_hold_one_row_an_id(spark):
    """An id that many rows share is one row of a sample, and so are rows without an id."""
    docs = spark.createDataFrame([(7 if i % 2 else None, f"some words of text {i}", "en", None, None) for i in range(400)] + [(1000 + i, f"andere Worte {i}", "de", None, None) for i in range(50)], DOC)
    sample, weights = common.sampled_by_class(docs, "lang", "doc_id", 1000)
    assert common.one_text_an_id(sample, "lang").count() == 52 and weights == {"en": 1.0, "de": 1.0}
    assert langid.fit_language_id(docs).langs == ["de", "en"]
    with pytest.raises(ValueError, match="more than 1"):
        common.sampled_by_class(docs, "lang", "doc_id", 10, classes=1)


def test_quality_learns(spark):
    good = [(i, f"these are plain words number {i} of an honest text about trees and rivers and hills {i * 7}", "en", "s", 1) for i in range(60)]
    bad = [(100 + i, f"$$ BUY ### NOW %% {i} !!! *** CHEAP &&& <<< DEAL >>> $$ {i * 3} ### GO *** NOW", "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(good + bad, DOC)
    model = quality.fit_quality(docs, labels(spark, [(r[0], int(r[0] < 100), 0) for r in good + bad] + [(None, 1, 0), (5, None, None)]))
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, model).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)


# Language ID.


def test_language(spark, odd, nothing):
    en, de = "the river and the hills of that land are wide and old", "der Fluss und die Hügel in diesem Land sind weit und alt"
    docs = spark.createDataFrame([(i, f"{(en, de)[i % 2]} {i}", ("en", "de")[i % 2], None, None) for i in range(90)] + [(1000, "123 456", "en", None, None), (1001, None, None, None, None)], DOC)
    model = langid.fit_language_id(docs)
    assert model.langs == ["de", "en"] and (model.weights == 0).any()
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(rows[i].lang_pred == ("en", "de")[i % 2] for i in range(90))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows.values())
    assert rows[1000].lang_pred == rows[1001].lang_pred == "und"
    assert langid.identified_documents(docs, model).count() == 90
    assert langid.identify(odd, langid.fit_language_id(nothing)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(odd, langid.fit_language_id(odd)).count() == odd.count()
    assert langid.identify(nothing, model).count() == 0


def test_ftrl_is_the_textbook():
    """Coordinate by coordinate, row by row, as the algorithm is written down."""
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.integers(3))) for _ in range(20)]
    a, b, l1, l2 = 2.0, 1.0, 0.01, 0.1
    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((b + math.sqrt(n[k])) / a + l2)
    for _ in range(3):
        for idx, val, y in rows:
            w = {(i, c): weight((i, c)) for i in idx.tolist() for c in range(3)}
            logits = [sum(v * w[i, c] for i, v in zip(idx.tolist(), val.tolist(), strict=True)) for c in range(3)]
            e = [math.exp(x - max(logits)) for x in logits]
            for i, v in zip(idx.tolist(), val.tolist(), strict=True):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / a * w[i, c]
                    n[i, c] += g * g
    got = langid.ftrl(rows, 3)
    assert all(got[i, c] == pytest.approx(weight((i, c)), abs=1e-5) for i in range(12) for c in range(3)) and not got[12:].any()


def test_language_against_brute_force(spark, odd):
    """Each document's language and score from its n-grams, counted one by one."""
    rows = [(i, f"{('the river and the hills', 'der Fluss und die Berge', 'la rivière et les collines')[i % 3]} {i}", ("en", "de", "fr")[i % 3], None, None) for i in range(90)]
    docs = spark.createDataFrame(rows, DOC).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    model = langid.fit_language_id(docs)

    def brute(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        raw, tf = f" {' '.join(text.lower().split())} ".encode(), Counter()
        for k in (2, 3, 4):
            for i in range(len(raw) - k + 1):
                h = sum(x * m for x, m in zip(raw[i : i + k], (0x01000193, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F), strict=False))
                tf[((h * 0x9E3779B1 + k) * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - langid.BITS] += 1
        val = {b: (1 + math.log(n)) * model.idf[b] for b, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in val.values()))
        logits = [sum(v / norm * float(model.weights[b, c]) for b, v in val.items()) / model.temperature for c in range(len(model.langs))]
        e = [math.exp(x - max(logits)) for x in logits]
        return model.langs[e.index(max(e))], max(e) / sum(e)

    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.identify(docs, model).collect())
    assert got == Counter({}) + sum((Counter({(i, b[0], round(b[1], 4)): n}) for (i, t), n in texts.items() for b in [brute(t)]), Counter())


def test_temperature_is_inside_its_bounds():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    sharp = np.eye(3)[y] * 5
    assert -7.9 < np.log(langid.temperature(sharp, y)) < 4.9  # all right: still finite
    noisy = np.where(rng.random(400) < 0.3, rng.integers(0, 3, 400), y)
    p = np.exp(sharp / (t := langid.temperature(sharp, noisy)))
    assert t > 1 and abs((p.max(1) / p.sum(1)).mean() - (noisy == y).mean()) < 0.02
    assert langid.temperature(np.zeros((5, 1)), np.zeros(5, int)) == 1.0


def test_held_out_rows_teach_nothing(spark):
    """Swapping the labels of held-out rows changes no prediction."""
    rows = [(i, f"text of kind {'alpha beta' if i % 2 else 'gamma delta'} {i}", "a" if i % 2 else "b", None, None) for i in range(60)]
    out = [(i, t, ("b" if lang == "a" else "a") if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, n) for i, t, lang, s, n in rows]
    got = [sorted(langid.identify(d, langid.fit_language_id(d)).collect()) for d in (spark.createDataFrame(rows, DOC), spark.createDataFrame(out, DOC))]
    assert got[0] == got[1]


@pytest.mark.skipif(not HAS_DATA, reason="no tables")
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit_language_id(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.97


# Embeddings.


def brute_links(vectors, least=0.9):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0 for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for v, g in zip(vectors, ok, strict=True)]
    links = {(i, j) for i in range(n) for j in range(n) if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and unit[i] @ unit[j] >= least}
    comp = list(range(n))
    for _ in range(n):
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return [sum(1 for a, _ in links if a == i) for i in range(n)], comp


@pytest.mark.parametrize("chunk", [12_000, 7])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 12))
    vectors = [list(map(float, centers[i % 6] + rng.standard_normal(12) * 0.25)) for i in range(120)]
    vectors += [vectors[0]] * 9 + [(np.array(vectors[0]) * 5).tolist(), None, [0.0] * 12, [float("nan")] * 12, [float("inf")] * 12, [None] * 12, [1.0, 0.0], [1.0, 0.1], []]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("n_links", F.lit("clash"))
    links, comp = brute_links(vectors)
    rows = sorted(neardup.near_duplicates(df, chunk=chunk).collect())
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows] == [(i, links[i], comp[i], comp[i] == i) for i in range(len(vectors))]


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3), (5, None), (100, 101)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# Toxicity.


def test_grammar():
    m = toxicity.Model({"vequ": 3.0}, {"idiot": 5.0})
    kinds = lambda t: {toxicity.KINDS[i] for i in np.flatnonzero(m.features(t)[: len(toxicity.KINDS)])}
    assert kinds("What an idiot.") == {"insult"}
    assert kinds("You are an idiot.") == {"aimed insult"}
    assert kinds("An idiot like you!") == {"aimed insult"}
    assert kinds("He is not an idiot.") == {"negated insult"}
    assert kinds("She said that some idiot came.") == {"reported insult"}
    assert kinds("She said so. Some idiot came.") == {"insult"}
    assert kinds("I will kill you.") == {"aimed threat"}
    assert kinds("vequx, plain") == {"insult"} and kinds("plain words") == set() and kinds("") == set()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(range(6)), max_size=14))
def test_grammar_is_its_rules(symbols):
    """The composed transducers say what the rules say, word by word."""
    want = []
    for i, s in enumerate(symbols):
        before = lambda x, reach, i=i: x in symbols[max(0, i - reach) : i]
        kind = 2 if before(toxicity.NEGATION, 3) else 3 if before(toxicity.REPORT, 99) else 1 if before(toxicity.TARGET, 4) or toxicity.TARGET in symbols[i + 1 : i + 5] else 0
        want.append(-1 if s not in (toxicity.INSULT, toxicity.THREAT) else kind + (4 if s == toxicity.THREAT else 0))
    assert toxicity.Grammar().matches(symbols) == want


def test_toxicity_against_brute_force(spark, odd):
    """Each document's score from its clauses, every word looked at with the words around it."""
    rng = np.random.default_rng(6)
    words = "you idiot moron kill not never said nobody house trees zorpling zorple plain dit ihr worthless".split()
    texts = [" ".join(w + (rng.choice([".", ",", "!"]) if rng.random() < 0.2 else "") for w in rng.choice(words, int(rng.integers(0, 30)))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    model = toxicity.Model({"zorp": 2.0}, {"idiot": 5.0, "moron": 4.0, "worthless": 1.5, "kill": 3.0}, np.linspace(-1, 2, 16), -1.0)

    def brute(text):
        top, total = [0.0] * 8, [0.0] * 8
        for clause in re.findall(r"(?:\S*[^\s.!?;:,]\s+|[.!?;:,]+[^\s.!?;:,]\S*\s+)*\S+", text or "") if text else []:
            read = [model.read(t) for t in clause.split()]
            for i, (s, w, _) in enumerate(read):
                if s not in (toxicity.INSULT, toxicity.THREAT):
                    continue
                before = lambda x, n, i=i: any(r[0] == x for r in read[max(0, i - n) : i])
                aimed = before(toxicity.TARGET, 4) or any(r[0] == toxicity.TARGET for r in read[i + 1 : i + 5])
                k = (2 if before(toxicity.NEGATION, 3) else 3 if before(toxicity.REPORT, 99) else int(aimed)) + (4 if s == toxicity.THREAT else 0)
                top[k], total[k] = max(top[k], w), total[k] + w
        return 1 / (1 + math.exp(-(float(np.dot([*top, *(math.log1p(x) for x in total)], model.coef)) + model.bias)))

    rows = toxicity.toxicity(docs, model).collect()
    want = Counter((r.doc_id, round(brute(r.text), 6)) for r in docs.collect())
    assert Counter((r.doc_id, round(r.score, 6)) for r in rows) == want


def test_chance_teaches_no_stems():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lant", "mern", "sott")]
    bags = [set(rng.choice(words, 12)) | {f"own{rng.integers(10**6):06}"} for i in range(400)]
    toxic = [b | ({"vexlorp"} if i % 2 else set()) for i, b in enumerate(bags[:100])]
    stems, whole = toxicity.learned_stems(toxic, bags[100:])
    assert {*stems, *whole} - {*toxicity.INSULTS, *toxicity.THREATS} <= {"vexlorp", "vexlor", "vexlo", "vexl"} and (stems or "vexlorp" in whole)


def test_threats_weigh_what_labels_say():
    clean = [{"beat", "egg", f"w{i}"} for i in range(50)] + [{f"v{i}"} for i in range(50)]
    _, whole = toxicity.learned_stems([{"kill", f"t{i}"} for i in range(30)], clean)
    assert whole["kill"] > 3 and whole["beat"] < 0.1 and whole["stab"] == 1.0


@pytest.mark.skipif(not HAS_DATA, reason="no tables")
def test_toxicity_held_out(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs.join(known, "doc_id", "left_semi"), toxicity.fit_toxicity(docs, known)).join(known, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted")).collect()
    got = dict(rows)
    assert got[1] > 0.85 and got[0] < 0.01  # one toxic label in ten stands on a text without any such word


def test_toxicity_learns(spark, odd, nothing):
    def text(i, bad):
        return f"a sentence with words {i} and more" + (" zorpling stuff" if bad and i % 3 else " you idiot" if bad else "")

    docs = spark.createDataFrame([(i, text(i, i % 4 == 0), None, None, None) for i in range(200)], DOC)
    known = labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, 1, None)])
    model = toxicity.fit_toxicity(docs, known)
    rows = toxicity.toxicity(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.toxicity(nothing, model).count() == 0
    assert toxicity.toxicity(odd, toxicity.fit_toxicity(nothing, labels(spark))).count() == odd.count()


# Mixing.


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets(spark):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.pareto(0.7, 9) * 100)} | {None: 50, "zero": 0}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix(spark, odd, nothing):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "w " * int(rng.integers(0, 40)), None, "hot" if i % 3 == 0 else f"s{i % 7}", None) for i in range(600)], DOC)
    rows = mixing.mixed(docs).collect()
    assert rows and sorted(rows) == sorted(mixing.mixed(docs.repartition(7)).collect())
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken = Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[sources[r.doc_id]] += r.taken
    for r in rows:
        assert abs(taken[sources[r.doc_id]] - r.target) <= 40
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert dict(copies.groupBy("doc_id").count().collect()) == {r.doc_id: r.copies for r in rows if r.copies}
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_is_native(spark, odd):
    for df in (mixing.mixed(odd), mixing.mixed_documents(odd)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# Tokens.


def test_token_files(spark, odd, nothing):
    tok = Tokenizer.from_file(JSON)
    manifest = tokenfiles.write_token_files(odd, JSON)
    rows = tokenfiles.read_token_files(manifest).collect()
    want, start = [], 0
    docs = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for d in docs:
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(nothing, JSON)).count() == 0
    assert sum(r.n_ids for r in manifest.collect()) == start


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab  .,, _\n\t'sé　\xa0.1\x00▁<>"), st.characters(min_codepoint=32, max_codepoint=0x4FF)), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces(text):
    pieces = pretokens.chunks(text)
    assert "".join(pieces) == text
    pattern = bpe.codec(RANKS).pattern
    whole = pattern.findall(text)
    assert [m for p in pieces for m in pattern.findall(p)] == whole
    assert [m for p in pieces for m in pretokens.pretokens(p, pattern.findall)] == whole
    if (marked := pretokens.marks(pa.array([text], pa.large_string()))[0].as_py()) is not None:
        assert [m for p in marked.split(pretokens.MARK) for m in pattern.findall(p)] == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_token_file_encoder(batch):
    e = tokenfiles.encoder(JSON)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_batch(batch)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe(text):
    c = bpe.codec(RANKS)
    ids = np.frombuffer(c.encode(text), "<u4").tolist()
    assert ids == tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={}).encode_ordinary(text)
    assert c.decode(c.encode(text)).decode() == text


def test_perfect_hash():
    c = bpe.codec(RANKS)
    assert sorted(k for k in c.table.keys if k is not None) == sorted(c.ranks)
    assert all(c.table.get(k) == r for k, r in c.ranks.items())
    assert c.table.get(b"\x00no such token\xff") is None and bpe.PerfectHash({}).get(b"a") is None


def test_memory_turns():
    old = bpe.PIECES
    c = bpe.Codec(RANKS)
    c.pieces, c.pretokens = pretokens.Memory(6), pretokens.Memory(6)
    texts = [f"word{i % 5} other{i} thing" for i in range(40)]
    assert [c.encode(t) for t in texts] == [bpe.codec(RANKS).encode(t) for t in texts] and bpe.PIECES == old


def test_bpe_rows(spark, odd, nothing):
    c = bpe.codec(RANKS)
    rows = bpe.encode_decode(odd, RANKS, with_ids=True).collect()
    assert len(rows) == odd.count() and bpe.encode_decode(nothing, RANKS).count() == 0
    for r in rows:
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens
    assert Counter(r.decoded for r in rows) == Counter(r.text or "" for r in odd.collect())
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(r.decoded) for r in rows)


def test_token_counts(spark, odd, nothing):
    vocab = tokencounts.load_unigrams(PIECES)
    ref = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = tokencounts.token_counts(odd, PIECES).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.n_tokens == len(ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)
    assert tokencounts.token_counts(nothing, PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=3), st.integers(-5, 0)), max_size=8))
def test_viterbi_ties(word, pieces):
    """Small vocabularies full of ties, against the library."""
    vocab = [("<unk>", 0.0), *{p: (p, float(s)) for p, s in pieces}.values(), *((f"<0x{i:02X}>", -20.0) for i in range(256))]
    ref = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert tokencounts.Counter(vocab).count(word) == len(ref.encode(word, add_special_tokens=False).ids)


# Sharding.


def test_shards(spark, odd, nothing):
    docs = spark.createDataFrame([(i, f"text {i % 150} " * (i % 150), None, None, None) for i in range(900)], DOC)
    rows = sharding.sharded(docs, shards=5).collect()
    assert len(rows) == 900
    load, slots, home = Counter(), {}, {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(sharding.sharded(docs.repartition(3), shards=5).collect()) == sorted(rows)
    got = sharding.sharded(odd).collect()
    assert len(got) == odd.count() and sharding.sharded(nothing).count() == 0


def test_schedule_is_lpt():
    sizes = {1: 7, 2: 5, 3: 4, 4: 4, 5: 2, 6: 2}
    assert sharding.schedule(sizes, 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0}


# Jaccard join.


def brute_sets(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(docs):
    sets = [(d, brute_sets(t)) for d, t in docs]
    comp = {d: d for d, _ in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = len(x & y)
            if x and y and 100 * n >= 75 * (len(x) + len(y) - n):
                p, q = root(a), root(b)
                comp[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets}


def near_copies(seed, groups=12, shared=True):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"shared{i}" for i in range(40))
    docs = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(6, 90)))]
        for _ in range(int(rng.integers(1, 25))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"edit{rng.integers(10**6)}"
            docs.append(" ".join(words) + (f" {passage}" if shared and rng.random() < 0.5 else ""))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    docs = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


@pytest.mark.parametrize("dense", [0, 100])
def test_jaccard_in_small_chunks(spark, monkeypatch, dense):
    """Groups cut by size and set, stars in parts, hot shingles dealt by set, joins without broadcasts and small slabs, as at scale."""
    for name, value in (("CHUNK", 4), ("SLAB", 400), ("HOT_IN_SLAB", 3), ("BLOCK", 4), ("DENSE", dense), ("SIDE", 300), ("WANTED", 0)):
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(5, groups=6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_jaccard_on_odd_rows(spark, odd, nothing):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[12] == 11 and got[0] == 0 and got[4] == 4 and got[None] is None
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(len(ODD_TEXTS)) if i != 12]
    assert jaccard.jaccard_components(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("sides", [1, 2])
def test_derived_answers(sides):
    """Overlaps that are derived from a similar set's give the links of all pairs."""
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 400, 60)) for _ in range(4)]
    sets = [np.unique(np.append(rng.permutation(base[i % 4])[: int(rng.integers(30, 60))], rng.integers(0, 10_000, int(rng.integers(0, 9))))).astype(np.uint64) for i in range(60)]
    side = np.arange(60) // 7 % sides
    forest = graph.Forest()
    for a, b in jaccard.linked_in_group(np.arange(60), sets, side, 75):
        n = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and (sides == 1 or side[a] != side[b]) and forest.join(a, b)
    for a in range(60):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and (sides == 1 or side[a] != side[b]):
                assert forest.root(a) == forest.root(b)


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.integers(0, 300))
def test_bitmaps_bound_the_difference(x, y, n):
    y |= set(sorted(x)[:n])
    a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
    assert jaccard.least_difference(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(x ^ y)
    assert jaccard.least_difference(jaccard.bitmap(a), jaccard.bitmap(a)) == 0


def test_one_of_each_with_repeated_ids(spark):
    """Unlike texts under one id all stay; a row goes only if its own text is a copy."""
    words = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    rows = [(1, words[0]), (1, words[1]), (2, words[0]), (3, words[2]), (3, words[2]), (4, words[3]), (None, words[3]), (5, ""), (5, "")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(1, words[0]), (1, words[1]), (3, words[2]), (4, words[3]), (None, words[3]), (5, "")], key=str)


@pytest.mark.parametrize("dense", [0, 100])
def test_every_link(spark, monkeypatch, dense):
    """All links between different sets, through pairs and through groups in parts."""
    for name, value in (("BLOCK", 4), ("DENSE", dense), ("SIDE", 300)):
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(9, groups=5)
    links, members = jaccard.jaccard_links(spark.createDataFrame(docs, "doc_id long, text string"))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in docs}
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, w in words.items()}
    first = {}
    for i, x in sorted(sets.items()):
        first.setdefault(x, i)
    want = {tuple(sorted((first[x], first[y]))) for x in first for y in first if x != y and 100 * len(x & y) >= 75 * len(x | y)}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert dict(members.collect()) == {i: first[x] for i, x in sets.items()}


def test_jaccard_links_rows_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (7, " ".join([*words, "more"])), (None, " ".join(["other", *words]))]
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(None, 7), (7, 7)}


def test_prefixes_are_long_enough():
    n = np.arange(1, 300)
    assert (jaccard.index_prefix(n, 75) <= jaccard.probe_prefix(n, 75)).all() and (jaccard.index_prefix(n, 75) >= 1).all()


def test_shards_against_brute_force(spark):
    """The shard of every document by scheduling without a heap: each bundle, largest first, to the shard with the least so far."""
    docs = spark.createDataFrame([(i, f"text {i % 90} " * (i * i % 70), None, None, None) for i in range(400)] + [(i, "hot", None, None, None) for i in range(400, 600)] + [(None, None, None, None, None)], DOC)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    bundle = {r.text: r.b for r in docs.select("text", F.pmod(F.xxhash64(F.sha2(raw, 256)), F.lit(sharding.BUNDLES)).alias("b")).distinct().collect()}
    size = Counter()
    for r in docs.collect():
        size[bundle[r.text]] += len((r.text or "").encode()) + 8
    load, home = [0] * 24, {}
    for b in sorted(size, key=lambda b: (-size[b], b)):
        home[b] = load.index(min(load))
        load[home[b]] += size[b]
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.sharded(docs).collect()
    assert all(r.shard == home[bundle[text[r.doc_id]]] for r in rows) and len(rows) == 601


# Queries.


@pytest.mark.skipif(not HAS_DATA, reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    tidy = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert tidy(got.select(*columns).collect()) == tidy(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


@pytest.mark.skipif(not HAS_DATA, reason="no tables")
def test_pipeline(spark):
    """Each stage's decisions against brute force on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == want, name
        from slidelake.llm.common import written

        out = written(out, "test")
        before, after = {r.doc_id: r.text for r in docs.collect()}, Counter(r.doc_id for r in out.collect())
        assert set(after) <= set(before)
        if "language" in name:
            model = langid.fit_language_id(docs)
            assert set(after) == {i for i, t in before.items() if (p := model.predict(t or ""))[0] != "und" and p[1] >= langid.ACCEPT_AT}
        if "quality" in name:
            model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            rule = lambda t: (c := brute_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]
            assert set(after) == {i for i, t in before.items() if rule(t) and model.score(t) >= quality.KEEP_AT}
        if "Jaccard" in name:
            assert set(after) == {c for _, c in brute_components(sorted(before.items())).values()} and set(after.values()) == {1}
        if "mixing" in name:
            assert max(after.values()) == 2
        docs = out
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len(library.encode_ordinary(r.text))) for r in docs.collect())
    assert P.run(spark, SF).count() == len(rows)
