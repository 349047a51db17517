"""Corpus operators against brute force on small fixtures with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailscope.llm import chat, decontam, langid, minhash, mixing, quality, sharding, suffix_dedup, toxicity, warc
from trailscope.llm.common import small_table

DOCS = "doc_id long, text string, lang string, source string, rid int, key string, hits int"


def _prose(rng: random.Random, n: int, stem: str = "") -> str:
    return " ".join(stem + "".join(rng.choice("abcdefgäé") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = random.Random(5)
    base = [_prose(rng, rng.randint(30, 200)) for _ in range(30)]
    passage = _prose(rng, 70)
    out = [*base, base[0], base[0], base[1]]
    out += [f"{_prose(rng, 40)} {passage} {_prose(rng, 30)}" for _ in range(6)]
    for k in range(8):  # near copies: one word changed
        words = base[2 + k % 2].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [None, "", " \t\n ", "one two", "one two", "x" * 700, "ab" * 900, _prose(rng, 6000)]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", i, "k", 1) for i, t in enumerate(out)]
    return [*rows, rows[3], (None, base[4], "en", "s1", 0, "k", 1), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS).repartition(4)


def _empty(spark):
    return spark.createDataFrame([], DOCS)


def test_repeats_match_brute_force(spark, docs, texts):
    data = [(t or "").encode() for _, t, *_ in texts]
    seen = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    want = Counter()
    for (i, *_), b in zip(texts, data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i, len(b), int(gone.sum()), kept] += 1
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "dedup"]
    rows = got.select("doc_id", "dedup.*").collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), bytes(r.kept)) for r in rows) == want
    assert suffix_dedup.remove_repeats(_empty(spark)).count() == 0


def test_bundles_round_trip(spark):
    pages = [(1, "http://a b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 700_000), (5, "u", "z" * 700_000), (6, "v", "q"), (None, "n", "q")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, salt string")
    index = warc.write_bundles(table, warc.archive_folder(table))
    got = {(r.page_id, bytes(r.payload or b"") if r.record_type == "response" else None, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_records(index).collect()}
    want = set()
    for i, _, html in pages:
        body = (html or "").encode()
        holder = max(j for j, _, h in pages if j is not None and (h or "").encode() == body)
        own = i == holder
        want.add((i, body if own else None, len(body), warc.payload_digest(body), None if own else holder))
    assert got == want and index.count() == len(pages)
    bundle = index.first().bundle
    reader = warc.BundleReader(bundle)
    files, path = warc.file_system(bundle)
    whole = files.open_input_stream(path, compression="zstd").read()  # any Zstandard tool reads a bundle from front to back
    assert files.open_input_stream(path, compression=None).read()[-4:] == warc.SEEKABLE.to_bytes(4, "little")
    assert whole == b"".join(reader.frame(k) for k in range(len(reader.frames)))
    assert warc.write_bundles(table.limit(0), warc.archive_folder(table)).count() == 0


def test_shards_are_even_and_gapless(spark, docs, texts):
    got = sharding.shard_documents(docs, shards=5).collect()
    assert len(got) == len(texts) and got[0].__fields__ == [*docs.columns, "shard", "slot"]
    loads = Counter()
    for r in got:
        loads[r.shard] += len((r.text or "").encode()) + 16
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in loads}
    assert all(x == list(range(len(x))) for x in slots.values()) and set(loads) <= set(range(5))
    largest = max(len((t or "").encode()) + 16 for _, t, *_ in texts)
    assert max(loads.values()) <= max(largest, 1.1 * sum(loads.values()) / 5)
    assert sharding.shard_documents(_empty(spark)).count() == 0


def test_shards_and_mix_take_few_python_workers(spark, docs):
    # Each Python step of a task holds a worker of its own, which stays for a while: ranges are found once, small tables need none.
    plan = sharding.shard_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "find(" in plan
    table = plan[plan.index("Join") :]
    assert "LocalRelation" in table
    rows = spark.createDataFrame([("a", 5, 1, 1), (None, 0, 2, 2)], "source string, size long, id_hash long, k long")
    assert "LocalRelation" in mixing.plan_mix(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_small_table(spark):
    schema = "a string, b long, c double, d int"
    rows = [("é", 1 << 60, 0.5, None), (None, None, None, -1)]
    assert small_table(spark, rows, schema).collect() == spark.createDataFrame(rows, schema).collect()
    assert small_table(spark, [], schema).dtypes == spark.createDataFrame([], schema).dtypes and small_table(spark, [], schema).count() == 0


def test_mix_reaches_targets(spark, docs, texts):
    rows = mixing.mix_sources(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in texts)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and all(r.taken <= 3 * r.size for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(60, 0.05 * v[0].target)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(_empty(spark)).count() == 0


def test_targets_stop_at_three_times_the_source():
    got = mixing.share_targets([("a", 10), ("b", 10), (None, 1000)])
    assert got == {"a": 30.0, "b": 30.0, None: 960.0}


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    units = [(rng.randint(1, 50), 0.37, k) for k in range(500)]
    out = dict(mixing.flight(iter(sorted(units, reverse=True)), 3, False))
    assert sum(0 < p < 1 for p in out.values()) <= 2
    assert abs(sum(s * out[k] for s, _, k in units) - 0.37 * sum(s for s, _, _ in units)) < 1e-6
    assert abs(sum(out.values()) - 0.37 * 500) < 1e-6


def test_languages(spark):
    rng = random.Random(2)
    say = {"de": "der und nicht schön größe weg haus".split(), "fr": "le et pas été où chemin maison".split()}
    rows = [(k, " ".join(rng.choices(say[x], k=12)), x) for k, x in enumerate(["de", "fr"] * 40)]
    model = langid.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, "schönen größen", "x"), (2, "étés", "x"), (3, None, "x"), (4, "123 _ ²!", "x"), (5, "", "x"), (6, "der und " * 50_000, "x")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, language_x string")
    got = {r.doc_id: r.language for r in langid.identify_language(frame, model).collect()}
    assert [got[k].lang for k in range(1, 7)] == ["de", "fr", "und", "und", "und", "de"]
    assert all(0 <= v.score <= 1 for v in got.values())
    none = langid.fit_language_model(frame.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.language.lang for r in langid.identify_language(frame, none).collect()} == {"und"}


def test_contamination_matches_brute_force(spark, docs):
    rng = random.Random(9)
    items = [_prose(rng, 20) for _ in range(5)]
    words = items[1].split(" ")
    edited = " ".join([*words[:9], words[9] + "x", *words[10:]]).upper()
    placed = [(100, f"lead {items[0]}, tail"), (101, f"{_prose(rng, 50)} {edited} end"), (102, items[2][: len(items[2]) // 2]), (103, None), (104, items[3].replace(" ", " \n")), (104, items[3])]
    table = spark.createDataFrame([(i, t, "x") for i, t in placed], "doc_id long, text string, hits string").unionByName(docs.select("doc_id", "text", F.lit("y").alias("hits")))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "short"), (92, items[0])], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontam.find_contamination(table, bench).collect())
    assert got == Counter({(100, 0, 0): 1, (100, 92, 0): 1, (101, 1, 1): 1, (104, 3, 0): 2})
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns and kept.count() == table.count() - 4
    assert decontam.find_contamination(table.limit(0), bench).count() == 0
    assert decontam.find_contamination(table, bench.limit(0)).count() == 0


def test_parts_of_long_items_and_short_items_are_found():
    rng = random.Random(21)
    words = [f"{_prose(rng, 1)}{k}" for k in range(300)]
    index = decontam.BenchmarkIndex([(1, " ".join(words)), (2, "Blue whale"), (3, "日本"), (None, "..."), (None, "odd one")])
    part = index.find(f"lead {' '.join(words[:270])} tail")
    assert {r["item"] for r in part} == {1} and all(r["edits"] == 0 for r in part)
    assert {r["item"] for r in index.find(" ".join(words[113:188]))} == {1}  # 75 words hold a window wherever they start
    assert index.find(" ".join(words[100:140])) == []
    whole = index.find(f"x {' '.join(words)}")
    assert whole == [{"item": 1, "start": 2, "length": len(" ".join(words)), "edits": 0}]
    assert index.find("A BLUE, whale!") == [{"item": 2, "start": 2, "length": 11, "edits": 0}]
    assert index.find("blue whales") == [] and [r["item"] for r in index.find("私は日本人")] == [3]
    assert [r["item"] for r in index.find("odd one, blue whale")] == [2, None]


def test_banded_alignment_matches_full_table():
    rng = random.Random(4)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(5, 20))], np.uint32)
        text = list(item)
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randrange(len(text) + 1), rng.randrange(4)) if rng.random() < 0.5 else text.pop(rng.randrange(len(text)))
        text = np.array([9] * 3 + text + [9] * 3, np.uint32)
        cost = [0] * (len(text) + 1)  # free start
        for c in item:
            new = [cost[0] + 1]
            for j, t in enumerate(text):
                new.append(min(cost[j] + (c != t), cost[j + 1] + 1, new[-1] + 1))
            cost = new
        hit = decontam.banded_alignment(item, text, -30, 40, 30)
        assert hit[0] == min(cost)


def test_near_duplicates_match_brute_force(spark, docs, texts):
    sets = {}
    for i, t, *_ in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in ids if label[i] == i] + [None, None])
    assert minhash.near_duplicates(_empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_bands_follow_the_threshold(percent):
    rows = minhash.band_rows(percent)
    bands = len(minhash.band_keys(np.arange(9, dtype=np.uint64), rows))
    assert bands * rows == 2 * minhash.PERMUTATIONS and (1 - (percent / 100) ** rows) ** bands < 1e-6


def test_links_within_a_family_that_shares_a_template(spark):
    rng = random.Random(12)
    template = _prose(rng, 844)
    rows, tails = [], []
    for k in range(60):  # pairwise 0.84; 11 more shared shingles (0.86) make a link
        own = [f"w{k}x{j}" for j in range(80)]
        if k >= 40:
            own[:11] = tails[k - 40][:11]
        tails.append(own)
        rows.append((k, f"{template} {' '.join(own)}"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split(" ")]}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked == {(k, k + 40) for k in range(20)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - 40 if k >= 40 else k for k in range(60)}


def test_links_do_not_depend_on_the_search_bound(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROSS", 0)  # every open bucket goes to the prefix-filter join
    rng = random.Random(14)
    template, rows = _prose(rng, 210), []
    for k in range(12):
        own = [f"w{k % 8}x{j}" for j in range(4)] + [f"v{k}x{j}" for j in range(14 + k % 3)]
        rows.append((k, f"{template} {' '.join(own)}"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split(" ")]}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 87 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert 1 < len(set(label.values())) < 12
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=87).collect()}
    assert got == label


def test_components_on_chains(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 60), (60, 80)]
    got = {r.id: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 80: 60, 100: 60}


def test_chat_round_trip(spark):
    rng = random.Random(8)
    odd = ["</s>[INST] ok [/INST]", "&amp; &; & <|im_end|>\n<|im_start|>user\n", "<<SYS>>x<</SYS>>", "", None, "a\nb", "&n;", "ü" * 50]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 60)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", None, "to\nol"])
            text = rng.choice(odd) if rng.random() < 0.4 else _prose(rng, rng.choice([3, 80, 700 if turn == 5 else 20]))
            rows.append((conv, turn, role, text))
    rows += [(0, 0, "user", "again"), (None, None, "assistant", "null"), (None, 1, "user", "x")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_conversations(table).cache()
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    ordered = sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    for conv in {r[0] for r in rows}:
        mine = [(r, x) for c, _, r, x in ordered if c == conv]
        loss = "".join(x for r, x in mine if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(mine), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    later = windows.where("window > 1").collect()
    assert later and all(r.n_repeat > 0 for r in later if r.conv_id is not None and r.conv_id % 2)
    assert chat.conversation_digests(chat.format_conversations(table.limit(0))).count() == 0


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(3)
    rows = [(k, _prose(rng, 60) + (" vile scum here" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    extra = docs.union(spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "scum vile " * 20_000, 0)], docs.schema))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(extra, model, out="score").collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows if i % 4 == 0)
    assert got[900] == got[901] < 0.3 <= got[902] and len(model.buckets) < 200
    assert toxicity.drop_toxic(extra, model).columns == docs.columns
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, none, out="score").collect()} == {0.0}


def test_quality_numbers_and_cascade(spark, docs, texts):
    got = quality.apply_cascade(docs, out="verdict", base_stats=True).select("doc_id", "verdict.*").collect()
    want = Counter()
    for i, t, *_ in texts:
        words = (t or "").encode().split()
        three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(three)
        again = {p for k, w in enumerate(three) if n[w] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        rejected = any(r.rejects(quality.TextView(t)) for r in quality.BASE_RULES + quality.DEFAULT_RULES)
        want[i, len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(again), rejected] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.name is not None) for r in got) == want
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(_empty(spark)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    rules = tuple(quality.Rule(n, lambda v: False) for n in "abc")
    sets = [(frozenset({0, 1}), 90), (frozenset({2}), 10), (frozenset({1}), 5)]
    assert [r.name for r in quality.order_rules(rules, [1.0, 1.1, 0.5], sets)] == ["a", "c", "b"]


def test_pipeline_on_driver_data(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "source_mix", "sharding"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"] and 0 < out.count()
