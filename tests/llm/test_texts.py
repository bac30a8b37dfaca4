"""Text operators against brute force, on small tables with odd rows."""

import gc
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from attestry.llm import bpe, jaccard, packing, quality, suffixes, toxicity, warc
from attestry.llm.queries import VOCABULARY
from attestry.llm.shared import SHUFFLES_GO, discard, shared_folder, stored
from attestry.llm.words import Words, text_bytes
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "x"), (2, "", "x"), (3, "   \n", "x"), (4, "one", None), (4, "one", None), (None, "one two three four five", "x"), (5, "é 漢字 🙂 b<|endoftext|>c", "x"), (6, "long " * 30_000, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, score string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(400)] + [(7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_words_follow_the_definition():
    texts = ["a b\tc", None, "", "  x  ", "é é 漢\x0b\x0cz", "a" * 5000 + " b"]
    data, offsets = text_bytes(pa.array(texts))
    words = Words(data, offsets)
    found = [bytes(data[s:e]).decode() for s, e in zip(words.start, words.end)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert words.count.tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashes = dict(zip(found, words.hashes().tolist()))
    again = Words(*text_bytes(pa.array(["zz c b", "a"])))
    assert again.hashes().tolist()[1:] == [hashes["c"], hashes["b"], hashes["a"]]


def test_bpe_equals_the_library():
    rng = random.Random(5)
    letters = ["a", "b", "the", "  ", "\n", "\t", "'s", "é", "²", "Ⅷ", "٣", "\x1c", "\x85", " ", " ", "漢字", "🙂", "<|endoftext|>", "<|endo", "_", "--", "don't", "́", "​", "12", "　", "ª", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinortsh") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += [rng.choice("ab-=*# e") * rng.randint(1, 400) for _ in range(200)] + ["x" * 20_000]
    library = Tokenizer.from_file(VOCABULARY)
    encoder, decoder = bpe.Vocabulary(VOCABULARY), bpe.Decoder(VOCABULARY)
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(encoder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(odd, none):
    coded = bpe.decode(bpe.encode(odd, "text", VOCABULARY), "ids", VOCABULARY)
    rows = coded.collect()
    assert [r["decoded"] for r in sorted(rows, key=str)] == [r["text"] or "" for r in sorted(rows, key=str)] and "score" in coded.columns
    found = bpe.digests(odd, VOCABULARY).collect()
    assert len(found) == len(ODD) and {r.n_tokens for r in found if r.doc_id in (1, 2)} == {0}
    assert bpe.digests(none, VOCABULARY).count() == 0


def test_quality_rules_find_what_labels_mark(spark, labels, odd, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = [(k, " ".join((word() + ("!!" if k % 2 == 0 else "")) for _ in range(40)), "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    held = [r for r in found.values() if r.held_out]
    assert len(found) == 400 and held and all(r.predicted == r.doc_id % 2 for r in held)
    rules = quality.fit(docs, labels)
    assert rules.rules and all(quality.STATISTICS[c[0]] for conditions, _ in rules.rules for c in conditions)
    odd_rows = quality.scores(odd, labels).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r.score <= 1 for r in odd_rows)
    assert {r.score for r in quality.scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.scores(none, labels).count() == 0


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon({"lowei": 0.9})
    kind = lambda t: [e for e, n in zip(toxicity.EVENTS, lexicon.events(t)) if n]
    assert kind("You idiot.") == ["i!"] and kind("what an idiot you are") == ["i!"] and kind("an idiot") == ["i"]
    assert kind("he is not an idiot") == ["i-"] and kind("don't be stupid") == ["i-"]
    assert kind('She said: "you idiot"') == ["i>"] and kind("I will kill you") == ["t!"] and kind("kill the process") == ["t"]
    assert kind("skillful trashcan") == [] and kind("") == [] and kind("du loweiung") == ["i!"]
    assert kind("nobody. idiot") == ["i"] and kind("not. idiot") == ["i"]


def test_toxicity_learns_stems(spark, labels, odd, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows = [(k, " ".join([word() for _ in range(20)] + (["zorg" + word()] if k % 2 == 0 else [])), "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert list(toxicity.fit(docs, labels).insults) == ["zorg"]
    held = [r for r in toxicity.scores(docs, labels).collect() if r.held_out]
    assert held and all(r.predicted == (r.doc_id + 1) % 2 for r in held)
    assert toxicity.scores(odd, labels).count() == len(ODD) and toxicity.scores(none, labels).count() == 0
    assert {r.predicted for r in toxicity.scores(docs, labels.where("false")).collect()} == {0}


def test_toxicity_stems_that_count_when_repeated():
    lexicon = toxicity.Lexicon({"lowei*2": 0.9, "lowei*3": 1.0})
    strength = lambda t: round(float(lexicon.events(t).sum()), 6)
    assert strength("a loweiung here") == 0 and strength("loweiung. then loweist") == 0.9 and strength("lowei lowei lowei") == 1.9
    assert strength("loweiung") == 0, "counted in each text anew"
    assert "zorg*2" in toxicity._features("Zorgan zorgen") and "zorg*3" not in toxicity._features("zorgan zorgen") and toxicity._features(None) == []


def test_toxicity_clauses_decide(spark):
    """Whatever the labels say, a match counts most when aimed and least when negated or reported."""
    texts = ["what an idiot {}", "{} you idiot", "she said you idiot {}", "not an idiot {}", "plain words {}"]
    docs = spark.createDataFrame([(k, texts[k % 5].format("x" * (k % 7))) for k in range(600)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    lexicon = toxicity.Lexicon({})
    alone, aimed, reported, negated, nothing = (float(model.probability(lexicon.events(t))) for t in texts)
    assert aimed > alone > max(reported, negated) and max(reported, negated) < 0.3 and nothing < 0.3 <= aimed


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(50)] + [(k, "one") for k in range(8, 40)] + [(None, "none")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(7, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.labelled_sample(docs, labels, "toxic", 4, 2, 10).collect()
    assert len(rows) <= 10 and len({r.doc_id for r in rows}) == len(rows)
    every = quality.labelled_sample(docs, labels, "toxic", 4, 5, 1000)
    assert sorted(r.doc_id for r in every.collect()) == list(range(7, 40)) and sorted(every.columns) == ["__label", "doc_id", "text"]
    assert quality.labelled_sample(docs.limit(0), labels, "toxic", 4, 2, 10).count() == 0


def shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_components(rows, n=4, percent=85):
    sets, up = {d: shingles(t, n) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((top(x), top(y)))
                up[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("seed, small, block, often", [(0, 4, 8, 2), (1, 32, 256, 8), (2, 2, 256, 2)])
def test_jaccard_components(spark, monkeypatch, seed, small, block, often):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range((5, 60, 3000)[seed])]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 60, 200]))] for _ in range(6)]
    rows = [(0, None), (3, ""), (6, " \n")]
    for d in range(3, 200):
        words = list(base[min(5, int(rng.expovariate(0.8)))]) if rng.random() < 0.85 else [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((3 * d, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()} == want
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs).collect())
    assert kept == sorted(d for d, (n, c) in want.items() if c == d)


def test_jaccard_links_of_large_buckets_follow_nodes_not_tokens(spark, monkeypatch):
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(400)], []
    for d in range(120):
        words = list(base)
        for at in rng.sample(range(400), rng.choice([4, 10])):
            words[at] = f"x{d}-{at}"
        rows.append((d, " ".join(words)))
    told, known = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: told.append(links.count()) or known(links))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()} == brute_components(rows)
    assert len(told) == 3 and max(told) < 10 * len(rows), told


def test_jaccard_order_knows_tokens_that_are_rare_in_every_stretch(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED_TOGETHER", 400)  # some 16 texts
    own = lambda d: " ".join(f"w{d}-{k}" for k in range(22))
    line = " ".join(f"line{k}" for k in range(10))
    rows = [(d, f"{own(d)}\n{line}" if d % 6 == 0 else own(-1) if d % 6 == 1 else own(d)) for d in range(240)]
    order = jaccard.often_seen(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), 4)
    tokens = lambda text: next(jaccard._text_sets(pa.array([text]), 4))
    known = set(order.tokens.tolist())
    assert set(tokens(line).tolist()) <= known
    assert not known & set(tokens(own(-1)).tolist())  # equal sets are one node


def test_jaccard_blocks_copy_a_crowd_a_bounded_number_of_times(spark):
    sizes = [(1, 7), (300, 3_000), (2_048, 80_000), (8_000, 3_000_000), (300, 20_000_000)]
    told = spark.createDataFrame(sizes, "nodes bigint, tokens bigint").select("nodes", jaccard._blocks(F.col("nodes"), F.col("tokens")).alias("n")).collect()
    assert [r.n for r in told] == [1, 2, 8, 8, 20]


def test_jaccard_leaves_only_tables_that_its_result_reads(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(w if rng.random() < 0.99 else f"x{d}" for w in base)) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    found = jaccard.similar_documents(docs)
    left = [p.name.rsplit("-", 1)[0] for p in set(folder.glob("llm-*")) - before]
    assert set(left) == {"llm-described", "llm-links"} and len(left) <= 4  # links: of nodes, of each search for components
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    gc.disable()
    try:
        before = files()
        frame = spark.range(1000).repartition(4, "id")
        out = stored(frame, "dealt")
        end = time.time() + 20
        while files() > before and time.time() < end:
            time.sleep(0.2)
        assert files() <= before
    finally:
        gc.enable()
    assert spark.conf.get(SHUFFLES_GO, None) in (None, "false") and out.count() == 1000
    folder = Path(out._stored_at.removeprefix("file:"))
    assert folder.exists()
    discard(out)
    assert not folder.exists()


def test_pipeline_keeps_only_the_table_of_its_last_stage(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(d, f"text {d}") for d in range(9)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stages = [(f"stage {k}", lambda spark, docs, sf_dir, k=k: docs.where(f"doc_id <> {k}")) for k in range(3)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(folder.glob("llm-*")) - before) == ["llm-stage-stage-2"]
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6, 7, 8]


def test_jaccard_sets_of_one_hash_are_told_apart(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(25)]
    rows = [(0, None), (1, "one two")]
    for d in range(2, 150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "other"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = jaccard.join_components(docs, bits=4)  # 16 names for over 100 sets
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def test_jaccard_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(6)
    often = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    order = jaccard.Order(often, rng.integers(8, 99, 50))
    met = {True: set(), False: set()}
    for _ in range(600):
        own = rng.integers(0, 1 << 63, int(rng.integers(1, 120)), dtype=np.uint64)
        x = np.unique(np.concatenate((own, rng.choice(often, 5))))
        y = x[rng.random(len(x)) > rng.choice([0.02, 0.1, 0.6])]
        y = np.unique(np.concatenate((y, rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64))))
        if not len(y):
            continue
        heads = zip(jaccard._heads(x, order, 85), jaccard._heads(y, order, 85), strict=True)
        met[jaccard.linked(x, y, 85)].add(all(len(np.intersect1d(a, b)) for a, b in heads))
    assert met[True] == {True} and False in met[False]


def test_jaccard_odd_tables(spark, odd, none):
    rows = jaccard.similar_documents(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id == 4} == {4}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in rows if r.doc_id in (1, 2, 3))
    assert jaccard.similar_documents(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1


def brute_passages(rows):
    words, first, found = {d: WORD.findall(t or "") for d, t in rows}, {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            e, j = first.setdefault(tuple(words[d][i : i + 50]), (d, i))
            if e != d or i - j >= 50:
                merged = found.setdefault(d, [])
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + 50
                else:
                    merged.append([i, i + 50])
    return found


@pytest.mark.parametrize("seed, vocab", [(0, 2), (1, 30), (2, 4000)])
def test_passages(spark, monkeypatch, seed, vocab):
    monkeypatch.setattr(suffixes, "LONG_RUN", 40)
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(vocab)}" for _ in range(n)]
    planted = [text(rng.randint(26, 120)) for _ in range(8)]
    rows = []
    for d in range(100):
        words = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(planted)
            words += p[rng.choice([0, 0, 9]) : len(p) - rng.choice([0, 0, 7])] + text(rng.randint(0, 40))
        words += ["x"] * rng.choice([0, 0, 0, 60, 200])
        rows.append((d, rng.choice([" ", "\n"]).join(words)))
    rows[5], rows[7] = (5, None), (7, rows[8][1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want, got, texts = brute_passages(rows), {}, dict(rows)
    for r in suffixes.passages(docs).collect():
        got.setdefault(r.doc_id, []).append([r.start_word, r.start_word + r.n_words])
        part = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert WORD.findall(part) == WORD.findall(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]
        assert all(s <= r.doc_id for s in r.source_ids)
    assert {d: sorted(v) for d, v in got.items()} == want
    for r in suffixes.without_repeats(docs).collect():
        words = WORD.findall(texts[r.doc_id] or "")
        gone = {i for a, b in want.get(r.doc_id, []) for i in range(a, b)}
        assert WORD.findall(r.text or "") == [w for i, w in enumerate(words) if i not in gone]


def test_passages_of_repeated_lines(spark):
    """A document that repeats a line, and an earlier one with a little more than a passage of it."""
    rng, rows = random.Random(11), []
    for period in range(10, 50):
        for n in (51, 56, 60, 65, 70):
            line = [f"p{period}n{n}v{rng.randrange(1 << 40)}" for _ in range(period)]
            whole, at = line * (1 + 350 // period), rng.randrange(period)
            rows += [(len(rows), " ".join(whole[at : at + n])), (len(rows) + 1, " ".join(whole[: period * rng.randint(5, 8)]))]
    got = {}
    for r in suffixes.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect():
        got.setdefault(r.doc_id, []).append([r.start_word, r.start_word + r.n_words])
    assert {d: sorted(v) for d, v in got.items()} == brute_passages(rows)


def test_passages_odd_tables(odd, none):
    assert suffixes.passages(none).count() == 0 and suffixes.without_repeats(none).count() == 0
    left = suffixes.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)


def brute_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if size - b >= n]
        if fit:
            bins.remove(max(fit))
        bins.append((max(fit) if fit else 0) + n)
    return sorted(bins)


def test_packing_is_best_fit(spark):
    rng = random.Random(3)
    for size in (10, 37, 64):
        lengths = [rng.randint(1, size) for _ in range(150)] + [rng.randint(1, size)] * 60
        docs = spark.createDataFrame(list(enumerate(lengths)), "k bigint, n bigint")
        rows = packing.pack(docs, "n", ["k"], (size,)).collect()
        used = {}
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert used.get(r.bin_id, 0) == r.bin_offset
            used[r.bin_id] = r.bin_offset + r.piece_length
        assert sorted(used.values()) == brute_best_fit(lengths, size) and {r.k for r in rows} == set(range(len(lengths)))


def test_packing_sizes_and_odd_rows(spark, none):
    rows = [(k, n) for k, n in enumerate([0, None, 1, 16, 17, 64, 65, 200, 8, 8, 8])] + [(9, 8)]
    packed = packing.pack(spark.createDataFrame(rows, "k bigint, n bigint"), "n", ["k", "n"], (8, 16, 64)).collect()
    whole = {}
    for r in packed:
        whole[r.k] = whole.get(r.k, 0) + r.piece_length
        if r.piece_length:
            assert r.bin_size == min(s for s in (8, 16, 64) if s >= r.bin_used) and r.bin_offset + r.piece_length <= r.bin_used
        else:
            assert r.bin_id is None
    assert whole == {0: 0, 1: 0, 2: 1, 3: 16, 4: 17, 5: 64, 6: 65, 7: 200, 8: 8, 9: 16, 10: 8}
    assert packing.packed_documents(none).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang=de><head><title>A &amp; B</title><script>x<y</script></head><body><!-- c --><p>Eins<br>zwei &lt;3</p><a href='/u?a=1&amp;b'>l</a></body>"
    pages = spark.createDataFrame([(1, "http://a.example/x", page), (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", ""), (4, "u", "<script>open")], "page_id bigint, url string, html string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8
    found = {(r.page_id, r.warc_type): r for r in rows}
    assert found[1, "conversion"].block == "A & B\nEins\nzwei <3\nl" and found[4, "conversion"].block == ""
    fields = found[1, "metadata"].block.split("\r\n")
    assert fields[:2] == ["title: A & B", "language: de"] and "source-header: HTTP/1.1 200 OK" in fields and "outlink: /u?a=1&b" in fields
    assert found[1, "metadata"].refers_to == found[1, "conversion"].refers_to and found[1, "conversion"].source_payload_digest == warc.digest(page.encode())
    warc.write_warc(warc.derivatives(pages), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.header["WARC-Record-ID"], bytes(r.block).decode()) for r in back) == sorted((r.record_id, r.block) for r in rows)
    assert all(warc.digest(bytes(r.block)) == r.header["WARC-Block-Digest"] for r in back)


def test_texts_that_agree_in_31_bits_of_their_hash_are_told_apart(spark):
    """Of rows of one id, or without id, none goes for the hash of another."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    invented = spark.range(160_000).selectExpr("concat('only here ', id) AS text").selectExpr("text", "xxhash64(text) & 2147483647 AS part")
    pairs = invented.groupBy("part").agg({"text": "collect_list"}).toDF("part", "texts").where("size(texts) > 1").limit(3).collect()
    assert pairs
    shared = words(1, 60)
    rows = [(d, t + " " + shared) for d, p in zip((1, None, None), pairs) for t in p["texts"]] + [(0, shared)]
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r["doc_id"]), r["text"].strip()) for r in out.collect()) == sorted((str(d), t.replace(" " + shared, "")) for d, t in rows)
