from __future__ import annotations

from pyspark.sql import functions as F

from recallkit.functions import classify as classes
from recallkit.functions import scalars
from recallkit.functions.tokens import query_phrases, tokens_of
from recallkit.operators import keyword, links, policy
from recallkit.sources import text as t


def test_size_chunks_join_to_the_text_and_keep_fences_whole():
    text = "a" * 50 + "\n```\n" + "b" * 80 + "\n```\n" + "c" * 120
    parts = t.by_size(text, 60)
    assert "".join(parts) == text
    assert any("b" * 80 in p and p.count("```") == 2 for p in parts)
    assert t.by_size("x", 60) == ["x"]
    assert t.by_size("", 60) == [""]


def test_an_open_fence_runs_to_the_end():
    text = "x" * 10 + "```" + "y" * 100
    assert t.by_size(text, 20) == [text]


def test_a_paragraph_end_beyond_half_is_preferred():
    text = "a" * 40 + "\n\n" + "b" * 40
    assert t.by_size(text, 60)[0] == "a" * 40 + "\n\n"
    assert t.by_size("a" * 10 + "\n\n" + "b" * 90, 60)[0] == "a" * 10 + "\n\n" + "b" * 48


def test_headings():
    text = "intro\n# One\nbody\n```\n# no heading\n```\n## Two\nmore\n### Three\nend"
    parts = t.by_heading(text)
    assert [p.split("\n")[0] for p in parts] == ["intro", "# One", "## Two"]
    assert "# no heading" in parts[1]
    assert t.by_heading("plain") == ["plain"]
    assert len(t.by_heading("# A\n" + "z" * 7000)) == 3
    assert t.of_note("# A\n" + "z" * 10) == ["# A\n" + "z" * 10]


def test_page_text():
    html = "<head><title>x</title></head><h2>T</h2><p>a<br>b &amp; c</p><script>no</script><div>d</div>"
    assert t.page_text(html) == "## T\n\na\nb & c\n\nd"


def test_turns_and_windows(spark):
    log = "User: a\nmore\nAI: b\nsystem: c\nUser: d"
    turns = t.turns_of(spark.createDataFrame([(1, log), (2, "no speaker")], "id int, text string"))
    assert [(r.id, r.turn, r.text) for r in turns.orderBy("id", "turn").collect()] == [
        (1, 0, "User: a\nmore"), (1, 1, "AI: b"), (1, 2, "system: c"), (1, 3, "User: d"), (2, 0, "no speaker"),
    ]
    found = t.windows_of(turns, 3).orderBy("id", "turn_start").collect()
    assert [(r.id, r.turn_start, r.turn_end) for r in found] == [(1, 0, 2), (1, 3, 3), (2, 0, 0)]


def test_tokens_fold_marks_and_case():
    assert tokens_of("Éa_b-ÇA 日本語の検索 x1") == ["ea", "b", "ca", "日本語の検索", "x1"]
    assert query_phrases('say "a-b" !!') == [["say"], ["a", "b"]]


def test_bm25_against_a_row_at_a_time_version(spark):
    import math

    texts = {1: "red fox red", 2: "red dog", 3: "blue fox", 4: "green", 5: "red archived"}
    m = spark.createDataFrame(
        [(i, x, None, "2024-01-01" if i == 5 else None) for i, x in texts.items()],
        "id int, content string, project string, archived_at string",
    )
    lengths = {i: len(x.split()) for i, x in texts.items()}
    mean = sum(lengths.values()) / 5

    def score(i, term):
        tf = texts[i].split().count(term)
        df = sum(term in x.split() for x in texts.values())
        idf = max(math.log((5 - df + 0.5) / (df + 0.5)), 0) or 1e-6
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / mean))

    found = {r.id: r.score for r in keyword.bm25(m, "red fox").collect()}
    assert found == {1: round(score(1, "red") + score(1, "fox"), 6)}
    assert [r.id for r in keyword.bm25(m, "red-dog").collect()] == [2]


def test_classes(spark):
    cases = [
        ("[🧠 Semantic] x", "manual", "semantic", False),
        ("[procedural] x", "manual", "procedural", False),
        ("今日はデプロイした。", "manual", "episodic", False),
        ("hello", "conversation", "episodic", False),
        ("hello", "manual", "episodic", True),
        ("hello", "url", "semantic", False),
        ("$ ls\n$ cd x", "manual", "procedural", False),
        ("HTTPとは何か", "manual", "semantic", False),
        ("手順: step 1", "manual", "procedural", False),
    ]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases], "text string, kind string")
    found = [r.c for r in df.select(classes.classify(F.col("text"), F.col("kind")).alias("c")).collect()]
    assert [(c.memory_type, c.is_fallback) for c in found] == [(k, f) for _, _, k, f in cases]
    assert found[4].importance == 0.25


def test_query_classes(spark):
    queries = ["TypeError in app", "なぜ why", "昨日の会議", "plain", "why ERROR"]
    df = spark.createDataFrame([(x,) for x in queries], "q string")
    found = [r.s for r in df.select(classes.analyze_query(F.col("q")).alias("s")).collect()]
    assert [s.depth for s in found] == [1, 3, 2, 2, 1]
    assert [s.time_decay for s in found] == [False, False, True, False, False]
    assert all(abs(s.vector_weight + s.keyword_weight + s.graph_weight - 1) < 1e-9 for s in found)


def test_references(spark):
    text = "see https://example.com/docs, (http://a.b/c?d=1). /usr/bin/x and /tmp or \"/etc/hosts/y\""
    row = spark.createDataFrame([(text,)], "t string").select(links.references(F.col("t")).alias("r")).first()
    assert sorted(row.r) == [
        "file:/etc/hosts/y", "file:/usr/bin/x", "url:http://a.b/c?d=1", "url:https://example.com/docs",
    ]


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        scalars.token_estimate(F.lit("abcdefgh")).alias("a"),
        scalars.token_estimate(F.lit("")).alias("b"),
        scalars.token_estimate(F.lit("日本")).alias("c"),
        scalars.mask_url(F.lit("https://u:p@h/x?y#z")).alias("d"),
        scalars.mask_value(F.lit("Token"), F.lit("v")).alias("e"),
        scalars.mask_value(F.lit("x"), F.lit("Bearer abc")).alias("f"),
        scalars.mask_value(F.lit("x"), F.lit("plain")).alias("g"),
        scalars.header_list(F.lit(" a, b,,a ")).alias("h"),
        scalars.bearer(F.lit("Bearer t0k")).alias("i"),
        scalars.json_payload(F.lit('{"a":1}')).alias("j"),
        scalars.json_payload(F.lit("[1]")).alias("k"),
        scalars.json_payload(F.lit("oops")).alias("l"),
        scalars.coerce_score(F.lit("7")).alias("m"),
        scalars.coerce_index(F.lit("x")).alias("n"),
        scalars.metadata_hash(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("o"),
        scalars.metadata_hash(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("p"),
    ).first()
    assert (row.a, row.b, row.c) == (3, 0, 1)
    assert row.d == "https://h/x"
    assert row.e == row.f == "*" * 10 and row.g == "plain"
    assert row.h == ["a", "b"] and row.i == "t0k"
    assert (row.j, row.k, row.l) == ('{"a":1}', '{"result":[1]}', '{"text":"oops"}')
    assert row.m == 1.0 and row.n == 0 and row.o == row.p


def test_decay_halves_each_month(spark):
    now = "2024-03-01 00:00:00"
    stamps = ["2024-03-01", "2024-01-31", "2024-01-01", "2024-05-01"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("s"))
    found = [r[0] for r in df.select(scalars.time_decay(F.col("s"), now)).collect()]
    assert found == [1.0, 0.5, 0.25, 1.0]
    score = scalars.lifecycle_score(F.lit(0.8), F.lit("2024-01-31").cast("timestamp"), F.lit(0.6), now)
    assert abs(spark.range(1).select(score).first()[0] - 0.67) < 1e-9


def test_addresses():
    assert all(t.restricted_address(a) for a in ("127.0.0.1", "10.1.2.3", "169.254.1.1", "::1", "224.0.0.1", "x"))
    assert not t.restricted_address("93.184.216.34")


def test_content_types(spark):
    values = ["text/html; charset=utf-8", "application/json", "image/png", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(t.allowed_content_type(F.col("v"))).collect()] == [True, True, False, False]


def test_secrets_in_nested_values(spark):
    from pyspark.sql import Row

    key = "sk-" + "a" * 20
    rows = [Row(i=1, m={"a": ["x", "y\n" + key]}), Row(i=2, m={key: ["x"]}), Row(i=3, m={"a": ["plain", "task-list"]}), Row(i=4, m=None)]
    df = spark.createDataFrame(rows, "i int, m map<string,array<string>>")
    assert [r.h for r in df.orderBy("i").select(scalars.holds_secret(F.col("m")).alias("h")).collect()] == [True, True, False, False]


def test_grants_and_faults(spark):
    agents = spark.createDataFrame([("a", ["read", "gone"])], "name string, intents array<string>")
    intents = spark.createDataFrame([("read", "f", ["x", "y"]), ("write", "g", ["z"])], "name string, filter string, tools array<string>")
    asked = [("a", "read", None), ("a", "read", ["y", "z"]), ("a", "read", []), ("a", "write", ["z"]), ("b", "read", None), ("a", "gone", None), ("a", "read", ["q"])]
    found = policy.grants(spark.createDataFrame(asked, "agent string, intent string, asked array<string>"), agents, intents).collect()
    by = {(r.agent, r.intent, tuple(r.asked) if r.asked is not None else None): (r.tools, r.error) for r in found}
    assert by["a", "read", None] == (["x", "y"], None) and by["a", "read", ("y", "z")] == (["y"], None)
    assert {k: e for k, (t, e) in by.items() if t is None} == {
        ("a", "read", ()): "NOTHING_ASKED", ("a", "write", ("z",)): "INTENT_NOT_ALLOWED", ("b", "read", None): "UNKNOWN_AGENT",
        ("a", "gone", None): "UNKNOWN_INTENT", ("a", "read", ("q",)): "NO_TOOL_ALLOWED",
    }
    filters = spark.createDataFrame([("f", "structural_allowlist", ["x", "z"]), ("g", "structural_allowlist", None), ("h", "none", None)], "name string, type string, schemas array<string>")
    assert {(r.kind, r.name, r.missing) for r in policy.filter_faults(filters, intents).collect()} == {("schema", "f", "z"), ("filter", "g", "schemas")}
