"""Cases that once went wrong: forged hash collisions, texts full of matches, letters, header names, ties in logs."""

import random
import time

from pyspark.sql import functions as F

from codonlake.llm import chat, kernels, language, repeats, secrets, warc
from tests.llm.test_operators import brute_secrets

#: Two printable texts of 144 bytes that share no string of 100 bytes, and whose polynomial hashes modulo 2**64 are equal.
MORSE = "01101001100101101001011001101001"


def morse_texts():
    block = lambda pair, swap: "".join(pair[int(b) ^ swap] for b in MORSE)
    return ["".join(block(p, swap) for p in ("S[", "&>")) + "kviywtmontlmnaaq" + "".join(block(p, swap) for p in ("Dh", "3A")) for swap in (0, 1)]


def test_repeats_of_colliding_contexts_lose_nothing(spark):
    texts = morse_texts()
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[1]])]
    out = {r["doc_id"]: r["n_removed"] for r in repeats.strip(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    assert out == {0: 0, 1: 0, 2: 144, 3: 144}


def test_repeats_context_digests_tell_content_and_place():
    import numpy as np

    data = np.frombuffer("".join(morse_texts()).encode() * 2, np.uint8)
    first, last = np.arange(0, 576, 144), np.arange(144, 577, 144)
    own, rest = repeats.context_digests(data, first, last, np.array([64, 64, 64, 65]))
    assert own[0] == own[2] and rest[0] == rest[2] and len({*own.tolist()}) == 3 and rest[1] == rest[3] and rest[0] != rest[1]
    assert len(kernels.span_hashes(data, first, last)) == 4


def test_secrets_of_a_text_with_many_matches(spark):
    many = "token=abcdef12 " * 60_000
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    took = []
    for text in ("token=abcdef12 " * 10, "token=abcdef12 " * 10, many):
        began = time.time()
        row = secrets.scan(df.withColumn("text", F.lit(text))).select("base").first()
        took.append(time.time() - began)
    assert took[2] - took[1] < 10  # about 1 s alone on this machine, beside 4 s that any text takes
    assert [(s["start"], s["end"]) for s in row["base"]] == [(15 * i, 15 * i + 14) for i in range(60_000)]


def test_secrets_of_a_text_with_many_tokens(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices(secrets.LETTERS_DIGITS, k=rng.choice((18, 24, 40)))) + "é" for _ in range(4000))
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(secrets.listed("base").alias("base"), "spans").first()
    assert row["base"] == brute_secrets(text) and len(row["spans"]) > 2000
    assert all(text[s["start"] : s["end"]].isascii() and len(text[s["start"] : s["end"]]) in (24, 40) for s in row["spans"])


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 64, 1000):
        values = [random.Random(n).randrange(-5, 9) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(secrets.summed(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_symbols_are_no_letters(spark, sf):
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = ["½ ²", "Ⅷ ⅷ", "①", "½ a", "ª", "_ 7"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, True, False, False, True]


WARC = "id long, url string, at long, kind string, etag string, modified long, headers map<string,string>, payload string"


def test_warc_header_names_and_weak_tags(spark):
    rows = [
        (1, "http://a.b/c", 1, "response", "v1", 5, {"Date": "d0", "content-Type": "t", "X-A": "1", "x-a": "2"}, "body"),
        (2, "http://a.b/c", 2, "revisit", 'W/"v1"', None, {}, None), (3, "http://a.b/c", 3, "revisit", "W/v1", None, {"DATE": "d1", "Cache-Control": "none", "Content-Type": "no"}, None),
        (4, "http://a.b/c", 4, "revisit", None, 5, {"date": "d2"}, None), (5, "http://a.b/c", 4, "revisit", None, 6, {}, None), (6, "http://a.b/c", 4, "revisit", "v2", 1, {}, None),
    ]
    got = {r["id"]: r for r in warc.resolve(spark.createDataFrame(rows, WARC)).collect()}
    assert {i: got[i]["status"] for i in range(2, 7)} == {2: "validator_mismatch", 3: "resolved", 4: "resolved", 5: "validator_mismatch", 6: "validator_mismatch"}
    assert got[3]["merged"] == {"date": "d1", "cache-control": "none", "content-type": "t", "x-a": "2"}
    assert got[4]["merged"]["date"] == "d2" and got[1]["merged"]["date"] == "d0"


def test_warc_rows_without_place_do_not_meet(spark):
    rows = spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 4 == 0, "http://a.b/c").alias("url_key"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("at"), F.when(F.col("id") % 8 == 0, F.struct(F.lit("e").alias("etag"), F.lit(1).cast("long").alias("modified"))).alias("answer")
    )
    out = warc.latest_before(rows, range_rows=500)
    assert out.count() == 20_000 and out.filter("found IS NOT NULL").count() == 4999
    assert out.filter("url_key IS NULL AND found IS NOT NULL").isEmpty()


def test_chat_turns_of_any_size_and_ties_in_logs(spark):
    turns = [(1, 2**61, "user", "late"), (1, -(2**62), "assistant", "early"), (2**63 - 1, 2**63 - 1, "user", "last"), (1, None, "user", "first")]
    folded = chat.folded(chat.events_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.rendered(folded).select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: ["first", "early", "late"], 2**63 - 1: ["last"]}
    log = [(1, 1, "delta", "a", "user", "old"), (1, 2, "regenerate", "a", None, None), (1, 2, "delta", "a", None, "new"), (1, 3, "delta", "b", "user", "x"), (1, 4, "delete", "b", None, None), (1, 5, "delta", "b", None, "back"), (1, 6, "edit", "c", "user", "p"), (1, 6, "edit", "c", "user", "q")]
    out = chat.folded(spark.createDataFrame(log, "conv_id long, seq long, kind string, msg_id string, role string, text string"))
    assert sorted(r["text"] for r in out.collect()) == ["back", "new", "q"]


def plain_language(train, texts, switch):
    """Trigram scores and the best path in plain Python, from the definition."""
    import math
    from collections import Counter

    def words(text):
        data = text.encode()
        low = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in data]
        out, i = [], 0
        while i < len(low):
            if not low[i]:
                i += 1
                continue
            j = i
            while j < len(low) and low[j]:
                j += 1
            grams = []
            for p in range(i, j):
                left, right = low[p - 1] if p else 0, low[p + 1] if p + 1 < len(low) else 0
                grams.append(((left * 0x9E3779B1 ^ low[p] * 0x85EBCA6B ^ right * 0xC2B2AE35) & 0xFFFFFFFF) * 0x27D4EB2F % 2**32 >> 16)
            first = ord(data[i : i + 4].decode(errors="ignore")[0])
            script = next(s for start, s in reversed(language.RANGES) if start <= first) if first < 0x10000 else 0
            out.append((grams, script, j - i))
            i = j
        return out

    counts, scripts = {}, {}
    for lang, text in train:
        for grams, script, _ in words(text):
            counts.setdefault(lang, Counter()).update(grams)
            scripts.setdefault(lang, Counter())[script] += 1
    langs = sorted(counts)
    totals = {x: sum(counts[x].values()) + 0.5 * language.BUCKETS for x in langs}
    writes = {s: [x for x in langs if scripts[x][s] / scripts[x].total() >= 0.001] or langs for s in range(language.SCRIPTS)}
    out = []
    for text in texts:
        own = words(text or "")
        if not own or not any(c.isalpha() for c in text):
            out.append(("und", 0.0, 0.0))
            continue
        best, came = None, []
        for grams, script, _ in own:
            here = {x: sum(math.log((counts[x][g] + 0.5) / totals[x]) for g in grams) + (0 if x in writes[script] else -50) for x in langs}
            if best is None:
                best = here
                continue
            top = max(langs, key=lambda x: best[x])
            came.append({x: x if best[x] >= best[top] - switch else top for x in langs})
            best = {x: max(best[x], best[top] - switch) + here[x] for x in langs}
        order = sorted(langs, key=lambda x: -best[x])
        path = [order[0]]
        for step in reversed(came):
            path.append(step[path[-1]])
        held = Counter()
        for x, (_, _, size) in zip(reversed(path), own, strict=True):
            held[x] += size
        lang, most = max(held.items(), key=lambda x: x[1])
        out.append((lang, most / held.total(), best[order[0]] - best[order[1]]))
    return out


def test_languages_are_those_of_the_definition(spark, sf):
    """Every prediction of a table against plain Python, with the texts in any batches; the pipeline's stage with it."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.substring("text", 1, 600))
    learn = rows.filter(~language.held_out())
    odd = ["½", "", None, "Жи ши the of", "the", "die der und the of and la le", "中文 한국", "\U0001f600 \U00010400", "x" * 300]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    whole = rows.select("doc_id", "text").unionByName(more)
    texts = {r["doc_id"]: r["text"] for r in whole.collect()}
    want = dict(zip(texts, plain_language([(r["lang"], r["text"]) for r in learn.filter("lang IS NOT NULL AND text IS NOT NULL").collect()], texts.values(), language.SWITCH), strict=True))
    model = language.train(learn)
    for parts in (1, 7):
        got = {r["doc_id"]: r for r in language.predict(whole.repartition(parts, "doc_id"), model).collect()}
        assert set(got) == set(texts)
        wrong = [i for i in texts if got[i]["lang_pred"] != want[i][0] or abs(got[i]["score"] - want[i][1]) > 1e-9]
        assert all(want[i][2] < 0.01 for i in wrong) and len(wrong) <= 1  # equal paths up to rounding
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_stage(spark, rows, sf).collect()}
    assert set(kept) == {r["doc_id"] for r in rows.collect() if want[r["doc_id"]][0] != "und"} and sum(kept[i] != want[i][0] for i in kept) <= 1


def test_op9_joins_read_one_exchange_of_texts(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = repeats.strip(spark.createDataFrame([(i, f"{i} " * 40 + "".join(chr(97 + j * j % 26) for j in range(200 + 5 * i))) for i in range(20)], "doc_id long, text string"))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "ReusedExchange" in plan
