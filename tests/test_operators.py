from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from opalspan.functions import spans as sp
from opalspan.functions.policy import policy
from opalspan.operators import generate, model_output, prep, rules, scoring, vault
from opalspan.sources import files

KEY = bytes(range(32))


def test_scores(spark):
    text = "Hi Camille Laurent, call 06 12 34 56 78."
    gold = [(3, 10, "GIVENNAME", "", "g", None), (11, 18, "SURNAME", "", "g", None), (25, 39, "TELEPHONENUM", "", "g", None)]
    pred = [gold[0], gold[1], (25, 36, "TELEPHONENUM", "", "p", None)]
    df = spark.createDataFrame([(text, gold, pred), (text, gold, None), (text, [(0, 40, "IGNORE", "", "g", None)], [gold[0]])], f"text string, gold {sp.SPANS}, pred {sp.SPANS}")
    a, b, c = scoring.scored(df).collect()
    assert (a["gold_chars"], a["leaked_chars"], a["strict_tp"], a["n_pred"], a["over_chars"], a["leaks"]) == (28, 3, 2, 3, 0, 1)
    assert (b["leaked_chars"], b["n_pred"]) == (28, 0) and (c["n_pred"], c["pred_chars"]) == (0, 0)
    assert {x["label"]: x["leaked_chars"] for x in a["by_label"]} == {"GIVENNAME": 0, "SURNAME": 0, "TELEPHONENUM": 3}


def test_selection(spark):
    rows = [("a", "s", 29.0, 35.0), ("b", "s", 29.6, 31.0), ("c", "s", 29.9, 31.0), ("d", "t", 1.0, 1.0)]
    r = spark.createDataFrame(rows, "tag string, testset string, leakage_chars double, over_redaction double").withColumns({c: F.lit(0) for c in ("items", "dropped_items", "outputs", "truncated")})
    r = r.withColumns({c: F.col(c) / 100 for c in ("leakage_chars", "over_redaction")})
    c = scoring.candidates(r, ["s"], ["t"])
    assert {x["tag"]: x["missing"] for x in c.collect()}["d"] == ["s"]
    assert scoring.choose(c, True).first()["tag"] == "b"


def test_wilson(spark):
    lo, hi = spark.range(1).select(*scoring.wilson(F.lit(0), F.lit(0))).first()
    assert (lo, hi) == (0.0, 1.0)


def test_vault(spark):
    rows = [("t", "c", 1, "I am Priya, card Ann", [(5, 10, "GIVENNAME", "", "g", None), (17, 20, "GIVENNAME", "", "g", None)]), ("t", "c", 2, "Priya again", [(0, 5, "GIVENNAME", "", "g", None)]), ("t", "d", 1, "Priya", [(0, 5, "GIVENNAME", "", "g", None)])]
    m = spark.createDataFrame(rows, f"tenant string, conversation string, turn int, text string, spans {sp.SPANS}")
    out, held = vault.pseudonymised(m, policy("analytics"), KEY)
    held = held.persist()
    got = {(r["conversation"], r["turn"]): r["redacted"] for r in out.collect()}
    # within a text the last value comes first
    assert got == {("c", 1): "I am <GIVENNAME_2>, card <GIVENNAME_1>", ("c", 2): "<GIVENNAME_2> again", ("d", 1): "<GIVENNAME_1>"}
    back = vault.restored(out.select("tenant", "conversation", "turn", F.concat("redacted", F.lit(" <CITY_9>")).alias("text")), held, KEY).collect()
    assert {(r["conversation"], r["turn"]): (r["restored"], r["n_restored"]) for r in back}[("c", 1)] == ("I am Priya, card Ann <CITY_9>", 2)
    moved = out.select("tenant", F.lit("d").alias("conversation"), "turn", F.lit("<GIVENNAME_2>").alias("text"))
    assert all(r["restored"] == "<GIVENNAME_2>" for r in vault.restored(moved, held, KEY).collect())
    wrong = vault.restored(out.select("tenant", "conversation", "turn", F.col("redacted").alias("text")), held, bytes(32)).collect()
    assert all(r["n_restored"] == 0 for r in wrong)
    late = F.current_timestamp() + F.expr("interval 2 days")
    assert vault.live_scopes(held, late).isEmpty() and vault.purged(held, late).count() == 2


def test_limiter(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t + datetime.timedelta(seconds=s)) for s in (0, 10, 20, 70, 200)], "u string, ts timestamp")
    assert [r["allowed"] for r in vault.limited(df, "u", "ts", 2, 4).orderBy("ts").collect()] == [True, True, False, True, False]


def test_model_output(spark):
    text = 'Ann met Ann and ann   lee, "Leeds".'
    items = [{"label": "GIVENNAME", "text": "Ann"}, {"label": "GIVENNAME", "text": "Ann"}, {"label": "SURNAME", "text": "Ann Lee"}, {"label": "CITY", "text": "'Leeds'"}, {"label": "X", "text": "met"}, {"label": "CITY", "text": " "}, {"label": "CITY", "text": "Rome"}]
    found, lost = model_output.locate(text, items)
    assert [(text[a:b], lab) for a, b, lab in found] == [("Ann", "GIVENNAME"), ("Ann", "GIVENNAME"), ("ann   lee", "SURNAME"), ("Leeds", "CITY")]
    assert [x[2] for x in lost] == ["unknown_label", "empty", "not_found"]
    pieces = list(model_output.windows(" ".join(f"w{i}" for i in range(400)), 300, 50))
    assert all(len(p) <= 300 for _, p in pieces) and all(b <= a + len(p) for (a, p), (b, _) in zip(pieces, pieces[1:]))
    with pytest.raises(ValueError):
        list(model_output.windows("x", 5, 5))
    df = spark.createDataFrame([("Ann Lee", [(0, 3, "GIVENNAME", "", "g", None), (4, 7, "SURNAME", "", "g", None)])], f"text string, s {sp.SPANS}")
    answer = df.select(model_output.answer_json(F.col("text"), F.col("s"))).first()[0]
    assert answer == '[{"label": "GIVENNAME", "text": "Ann"}, {"label": "SURNAME", "text": "Lee"}]'


def test_bioes(spark):
    text = "Ann Lee Leeds"
    tags = [("d", 0, 3, "B-NAME", 1.0), ("d", 4, 7, "E-NAME", 0.5), ("d", 8, 13, "S-CITY", 1.0)]
    df = spark.createDataFrame(tags, "doc_id string, start int, end int, entity string, score double").withColumn("text", F.lit(text))
    assert sorted((r["start"], r["end"], r["label"], r["score"]) for r in model_output.bioes(df).collect()) == [(0, 7, "NAME", 0.75), (8, 13, "CITY", 1.0)]


NOISY = [
    ("pay up to $", "500", " per month", "CREDITCARDNUMBER", "money_as_card"),
    ("about ", "45", "% of staff", "AGE", "age_not_a_person"),
    ("employees aged ", "30", " or so", "AGE", "age_not_a_person"),
    ("from 29 to ", "35", " in all", "AGE", "age_not_a_person"),
    ("the ratio (", "male", " to female", "GENDER", "group_attribute"),
    ("your ", "ZIP", " requirements apply", "ZIPCODE", "reference_not_id"),
    ("fee payable via ", "4111", " today", "CREDITCARDNUMBER", None),
    ("she is ", "45", " and lives here", "AGE", None),
]


def test_noise(spark):
    rows = [(i, a + v + b, [(len(a), len(a) + len(v), lab, v, "g", None)]) for i, (a, v, b, lab, _) in enumerate(NOISY)]
    df = spark.createDataFrame(rows, f"doc_id int, text string, spans {sp.SPANS}")
    got = {r["doc_id"]: r["rule"] for r in rules.noise(df).collect()}
    assert got == {i: x[4] for i, x in enumerate(NOISY) if x[4]}
    assert {r["doc_id"] for r in rules.without_noise(df).collect()} == {6, 7}


def test_rejections(spark):
    cases = [
        ("Call me on 415 555 0100 now", [("TELEPHONENUM", "415 555 0100")], [], None),
        ("", [], [], "length"),
        ("Hello there", [("GIVENNAME", "Ann")], [], "missing value GIVENNAME"),
        ("May I see May", [("GIVENNAME", "May")], [], "ambiguous GIVENNAME"),
        ("Please call us on 415 555 0100", [("TELEPHONENUM", "415 555 0100")], [], "phone given as the company's"),
        ("Sent: 1 May 1990 from", [("DATE", "1 May 1990")], [], "date used as a header date"),
        ("My order is 123456789", [], [], "unlabelled digit run"),
        ("Mail a.b@example.com", [], [], "unlabelled email"),
        ("Ask Dr. Patel", [], [], "unlabelled title + name"),
        ("my card 4000123412341234 ok", [], ["4000123412341234"], "look-alike presented as a card"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "text string, v array<struct<label:string,text:string>>, keep array<string>")
    assert [r[0] for r in df.select(rules.rejection(F.col("text"), F.col("v"), F.col("keep"))).collect()] == [c[3] for c in cases]


def test_record_errors(spark):
    df = spark.createDataFrame([("Ann Lee", [(0, 2, "GIVENNAME", "An", "g", None), (1, 7, "NOPE", "nn Lee", "g", None)], ["Lee", "zzz"])], f"text string, s {sp.SPANS}, keep array<string>")
    errors = df.select(rules.record_errors(F.col("text"), F.col("s"), F.col("keep"))).first()[0]
    assert [e.split(" ")[0] for e in errors] == ["inside", "unknown", "inside", "overlaps", "kept", "kept"]


def test_prep(spark):
    docs = spark.createDataFrame([(i, "US" if i < 60 else "GB", "x", [(0, 1, "A" if i % 3 else "B", "x", "g", None)]) for i in range(120)], f"id int, region string, text string, spans {sp.SPANS}")
    first = [r["region"] for r in prep.stratified_order(docs, 1).limit(30).collect()]
    assert 12 <= first.count("US") <= 18
    pool = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v"), (2, "z y x")], "id int, text string")
    cand = spark.createDataFrame([(7, "a b c d e f g h i j k l m n o p q r s t u w"), (8, "Z y X"), (9, "")], "id int, text string")
    got = {(r["id"], r["other"]): round(r["jaccard"], 3) for r in prep.near_duplicates(cand, pool).collect()}
    assert got == {(7, 1): round(17 / 19, 3), (8, 2): 1.0}
    turns = spark.createDataFrame([(1, 0, "agent", "Hi", []), (1, 1, "action", "x", []), (1, 2, "customer", "Ann", [(0, 3, "GIVENNAME", "Ann", "g", None)])], f"conv_id int, turn int, role string, text string, spans {sp.SPANS}")
    t = prep.transcripts(turns).first()
    assert t["text"] == "Agent: Hi\nCustomer: Ann" and t["text"][t["spans"][0]["start"] : t["spans"][0]["end"]] == "Ann"


def test_contamination(spark):
    e = spark.createDataFrame([("one two three four five six seven eight",)], "text string")
    d = spark.createDataFrame([(1, "so One two, three four five six seven eight."), (2, "one two three"), (3, None)], "doc_id int, text string")
    assert [r["doc_id"] for r in rules.contaminated(d, e).collect()] == [1]


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    (tmp_path / "x.jsonl").write_text('{"id": "a", "text": "Ann", "spans": [{"start": 0, "end": 3, "label": "GIVENNAME"}], "more": 1}\n\n{"id": "b", "text": "é"}\n', encoding="utf-8")
    df = files.read_examples(spark, path)
    assert [(r["id"], len(r["spans"])) for r in df.orderBy("id").collect()] == [("a", 1), ("b", 0)]
    assert files.read_examples(spark, path, 2).count() == 1
    files.write_examples(df, str(tmp_path / "out"))
    again = files.read_examples(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "two.jsonl").write_text('{"id": "a", "text": ""}\n{"id": "a", "text": ""}\n')
    with pytest.raises(ValueError):
        files.Catalogue({"two": str(tmp_path / "two.jsonl")}).load(spark, "two")
    (tmp_path / "runs").write_text("# c\nx | c.yaml | a=1 | s t\ny | d.yaml | | s\n")
    assert [r["tag"] for r in files.read_runs(spark, str(tmp_path / "runs"), 1, 2).collect()] == ["y"]
    lit = spark.createDataFrame([("[{'start': 0, 'end': 1, 'label': None}]",), ("oops",)], "v string").select(files.literal_column(F.col("v")))
    assert [x[0] and x[0][0]["end"] for x in lit.collect()] == [1, None]
    assert files.with_overrides({"a": {"b": 1}}, ["a.b=2.5"]) == {"a": {"b": 2.5}}


def test_generated(spark):
    a, b = generate.generated(spark, 50, 1).collect(), generate.generated(spark, 50, 1).repartition(7).orderBy("id").collect()
    assert sorted(a) == sorted(b) and all(r["text"][r["start"] : r["end"]] == r["value"] for r in a)


def test_realigned(spark):
    text = "Ann Lee met Bob. " * 3
    log = [("a", 0, 34, '[{"label": "GIVENNAME", "text": "ann"}, {"label": "GIVENNAME", "text": "Bob"}]'), ("a", 17, 34, '[{"label": "GIVENNAME", "text": "Ann"}, {"label": "X", "text": "q"}]')]
    log, docs = spark.createDataFrame(log, "id string, offset int, chunk_len int, raw string"), spark.createDataFrame([("a", text), ("b", "none")], "id string, text string")
    starts = lambda fuzzy: sorted(s["start"] for r in model_output.realigned(log, docs, fuzzy)[0].collect() for s in r["spans"])
    assert starts(False) == [12, 17] and starts(True) == [0, 12, 17]
    assert sorted(r["reason"] for r in model_output.realigned(log, docs, False)[1].collect()) == ["not_found", "unknown_label"]


def test_windows_and_places():
    """Against the rules said step by step."""
    import random

    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choices("ab \n", [6, 6, 1, 1], k=r.randint(0, 90)))
        size = r.randint(5, 30)
        overlap = r.randint(0, size - 2)
        at, end, want = 0, -1, []
        while end < len(text):
            end = min(len(text), at + size)
            if end < len(text):
                low = at + overlap + 1
                places = [i for i in range(low, end) if text[i] == " "] or [i for i in range(low, end) if text[i] == "\n"]
                end = places[-1] if places else end
            want.append((at, text[at:end]))
            spaces = [i for i in range(max(0, end - overlap), end) if text[i] == " "]
            at = spaces[0] + 1 if spaces else end - overlap
        assert list(model_output.windows(text, size, overlap)) == want
    found, lost = model_output.locate("b a B a", [{"label": "CITY", "text": x} for x in ("a", "b", "b", "B", "a", "a", " ")])
    assert [f[:2] for f in found] == [(0, 1), (2, 3), (4, 5), (6, 7)] and [x[2] for x in lost] == ["not_found", "not_found", "empty"]


def test_in_region(spark):
    r = __import__("random").Random(1)
    rows = [(str(k), " ".join(r.choices([f"w{i}" for i in range(200)], k=30)), "IN" if k % 2 else "GB") for k in range(40)]
    pool = spark.createDataFrame(rows, "id string, text string, region string").withColumn("spans", sp.no_spans())
    test, train = pool.where("id in ('1', '3')"), pool.where("id = '5'").withColumn("text", F.concat("text", F.lit(" more")))
    got = [x["id"] for x in prep.in_region(pool, test, train, ["IN"], 10, 7).collect()]
    assert len(got) == 10 and not {"1", "3", "5"} & set(got) and all(int(x) % 2 for x in got)


def test_draws_are_streamed(spark):
    """Draws are a row each, neither counted nor sorted, and a pair of systems shares them."""
    import hashlib

    rows = [(s, i, 5 + i % 3, i % 4, 6, i % 2, 1, int(i % 4 > 0)) for s, m in (("de", 7), ("en", 4)) for i in range(m)]
    schema = "set string, pos long, gold_chars int, leaked_chars int, pred_chars int, over_chars int, has_gold int, leaks int"
    a = spark.createDataFrame(rows, schema)
    b = a.where("set = 'de' and pos <> 2").withColumn("leaked_chars", F.lit(1))
    draws = scoring._replicates(a, 3, 5)
    assert draws.count() == 3 * len(rows)
    assert "ShuffledHashJoin" in scoring._drawn(a, draws)._jdf.queryExecution().executedPlan().toString()
    want = []
    for rep in range(3):
        picked = [int(hashlib.md5(f"5|de|{rep}|{i}".encode()).hexdigest()[:15], 16) % 7 for i in range(7)]
        leak = lambda get, keep: sum(get(rows[i]) for i in picked if keep(i)) / sum(rows[i][2] for i in picked if keep(i))  # noqa: E731, B023
        want.append(leak(lambda r: r[3], lambda i: True) - leak(lambda r: 1, lambda i: i != 2))
    got = {r["metric"]: r for r in scoring.paired_bootstrap(a, b, 3, 5).collect()}["leak"]
    assert got["a_better"] == round(sum(x < 0 for x in want) / 3, 6)
    low, mid, high = sorted(want)
    assert abs(got["lo"] - (low + 0.05 * (mid - low))) < 1e-5 and abs(got["hi"] - (mid + 0.95 * (high - mid))) < 1e-5


def test_class_pairs_by_rare_hashes(spark):
    """A passage that every set holds joins none of them; pairs are those of brute force."""
    import random

    r = random.Random(3)
    common = [r.getrandbits(63) - 2**62 for _ in range(30)]
    sets = {}
    for k in range(60):
        own = [r.getrandbits(63) - 2**62 for _ in range(60)]
        sets[2 * k] = common + own
        if k % 3 == 0:
            sets[2 * k + 1] = common + own[: 60 - k % 12] + [r.getrandbits(63) - 2**62 for _ in range(k % 7)]
    a = spark.createDataFrame([(c, sorted(h)) for c, h in sets.items()], "c long, h array<long>")
    b = a.toDF("d", "g")
    want = {(c, d) for c in sets for d in sets if len(set(sets[c]) & set(sets[d])) >= 0.8 * len(set(sets[c]) | set(sets[d]))}
    assert {(x["c"], x["d"]) for x in prep.class_pairs(a, b, 0.8).collect()} == want
    within = {(x["c"], x["d"]) for x in prep.class_pairs(a, b, 0.8, True).collect()}
    assert within == {(c, d) for c, d in want if c < d} and within
    seen = spark.sparkContext.broadcast(prep._counters(a))
    assert not {x["p"] for x in prep._prefixes(a, seen, 0.8).collect()} & set(common)


def test_cards_by_customer(spark, tmp_path):
    """A row for each customer, numbers met twice too, dealt to tasks; the turn is made once, not again in every lambda."""
    import duckdb

    from opalspan.plans.oracle import ORACLE
    from opalspan.plans.queries import QUERIES

    spark.createDataFrame([(7,), (7,), (12345,), (9_999_999,)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    df = QUERIES["transcript_cards"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(ORACLE["transcript_cards"]).fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("lpad(") < 20


def test_sets_are_made_once(spark, tmp_path):
    """Near-duplicates by bands: what is joined holds ids and bands, no vectors; texts are cut into shingles once for the
    bands and the pairs."""
    from opalspan.operators import lsh_index, prep

    rows = [(k, " ".join(f"w{k % 4}x{i}" for i in range(40 + k))) for k in range(12)]
    docs = spark.createDataFrame(rows, "id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pairs = prep.near_duplicates_lsh(docs, docs, 0.8)
    sets = {k: {t[i : i + 5] for t in [tuple(w.split())] for i in range(len(t) - 4)} for k, w in rows}
    want = sorted((a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert want and sorted((r["id"], r["other"]) for r in pairs.collect()) == want
    assert "features" not in plan(pairs) and "xxhash64" not in plan(pairs)
    index = lsh_index.Index(spark, "made_once", str(tmp_path / "index"))
    try:
        index.add(docs.where("id % 2 = 0"))
        # the names of the members, and that they are not null
        assert plan(index.near(docs.where("id % 2 = 1"))).count("xxhash64") <= 2
    finally:
        index.drop()


def _versions(seed: int, texts: int, words: int, versions: int) -> dict[int, str]:
    import random

    r = random.Random(seed)
    out = {}
    for _ in range(texts):
        w = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(versions):
            out[len(out)] = " ".join(w)
            w[r.randrange(words)] = f"v{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("most", [(4096, 4 << 20), (5, 4 << 20), (4096, 300)])
def test_lsh_groups_dealt_to_blocks(spark, most):
    """Each pair once, within one table and between two with the same ids, whether a group is compared whole or by blocks."""
    texts = _versions(3, 3, 90, 12)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts.items() for w in [t.split()]}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (99, None)], "id long, text string")
    got = sorted((r["id"], r["other"], round(r["jaccard"], 9)) for r in prep.near_duplicates_lsh(docs, docs, 0.8, at_once=most[0], hashes_at_once=most[1]).collect())
    assert got == sorted((a, b, round(share(a, b), 9)) for a in sets for b in sets if b < a and share(a, b) >= 0.8) and len(got) > 40
    own, pool = docs.where("id % 3 > 0"), docs.where("id % 3 < 2").select(F.col("id").cast("int").alias("id"), "text")
    pairs = prep.near_duplicates_lsh(own, pool, 0.8, at_once=most[0], hashes_at_once=most[1])
    got = sorted((r["id"], r["other"], round(r["jaccard"], 9)) for r in pairs.collect())
    assert got == sorted((a, b, round(share(a, b), 9)) for a in sets if a % 3 > 0 for b in sets if b % 3 < 2 and share(a, b) >= 0.8)
    assert [x.dataType.simpleString() for x in pairs.schema] == ["bigint", "int", "double"]


def test_lsh_writes_less_than_it_reads(spark, tmp_path, monkeypatch):
    """What is written for the pairs is a small part of the texts: the sets of all would be more than the texts."""
    from pathlib import Path

    texts = _versions(5, 150, 400, 2)
    spark.createDataFrame(texts.items(), "id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr("opalspan.sources.shared.scratch", lambda spark, name: str(tmp_path / "written" / f"{name}-{len(list(tmp_path.glob('written/*')))}"))
    assert prep.near_duplicates_lsh(docs, docs, 0.8).count() == 150
    size = lambda at: sum(p.stat().st_size for p in Path(tmp_path, at).rglob("*.parquet"))
    assert 0 < size("written") < size("docs") / 4
