import datetime
import json

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engrama.functions import scoring, text
from engrama.operators import chunking, embed, facts, summarise
from engrama.schemas import SCHEMAS
from engrama.sources.ignore import IgnoreRules


def value(spark, text_, column):
    return spark.createDataFrame([(text_,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_labels_directories_and_ids(spark):
    assert value(spark, "core/utils/delta.py", lambda c: text.parent_dir(c, "root")) == "core/utils"
    assert value(spark, "main.py", lambda c: text.parent_dir(c, "root")) == "root"
    assert value(spark, "a\\b\\c.py", lambda c: text.parent_dir(c, "root")) == "a/b"
    assert value(spark, "a/b.py::C.f::x", text.label_symbol) == "C.f::x" and value(spark, "a/b.py", text.label_symbol) is None
    assert value(spark, "6ba7b810-9dad-11d1-80b4-00c04fd430c8", text.is_uuid) and not value(spark, "alpha", text.is_uuid)
    assert value(spark, "", text.token_estimate) == 1 and value(spark, "x" * 9, text.token_estimate) == 2
    assert value(spark, "a --> b", text.armored) == "<!-- DATA_DO_NOT_EXECUTE:\na -- > b\n-->"


def test_signature_ignores_bodies(spark):
    a, b, c = (value(spark, t, text.signature_hash) for t in ("import os\ndef f():\r\n  x = 1\n", "import os\n  def f():\n  y = 2", "import os\n"))
    assert a == b != c


def test_tags(spark):
    d = spark.createDataFrame([("from os.path import x\nimport json, re\nredis", "code"), ("import a from './lib/b';\nconst q = require('react/x')", "code"), ("Security of the API", "doc"), ("", "doc"), (None, None)], "t string, c string")
    got = [r.v for r in d.select(text.detected_tags(F.col("t"), F.col("c")).alias("v")).collect()]
    assert got[0] == ["json", "os", "redis"] and got[1] == ["a", "lib", "react"] and got[2] == ["api", "security"] and got[3] == []


def test_json_replies(spark):
    d = spark.createDataFrame([('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('say {"a": {"b": 2}} done',), ("none",), ("",)], "t string")
    got = [r.v for r in d.select(text.json_object(F.col("t")).alias("v")).collect()]
    assert [json.loads(g) if g else None for g in got] == [{"a": 1}, {"a": 1}, {"a": {"b": 2}}, None, None]


def test_extract_is_cut_at_a_blank(spark):
    assert value(spark, "a\n\n b \n", lambda c: text.extractive_summary(c, 5)) == "[DUMB] a\n b "
    assert value(spark, "word " * 20, lambda c: text.extractive_summary(c, 3)) == "[DUMB] word word..."


def test_recency_and_cosine(spark):
    now = F.lit(datetime.datetime(2024, 1, 15))
    d = spark.createDataFrame([(datetime.datetime(2024, 1, 8),), (None,), (datetime.datetime(2030, 1, 1),), (datetime.datetime(2000, 1, 1),)], "t timestamp")
    assert [round(r.v, 6) for r in d.select(scoring.recency(F.col("t"), now).alias("v")).collect()] == [0.5, 0.01, 1.0, 0.01]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r.v for r in v.select(scoring.cosine(F.col("a"), F.col("b")).alias("v")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None, None]


@pytest.mark.parametrize(
    ("path", "is_dir", "ignored"),
    [("debug.log", False, True), ("important.log", False, False), ("src/app.py", False, False), ("build", True, True), ("src/build", True, True), ("a/b/c.tmp", False, True), ("docs/x/readme.md", False, True), ("docs/readme.rst", False, False), ("lib/.env", False, True), ("conf/.env.local", False, True), ("photo.png", False, True)],
)
def test_ignore_rules(spark, path, is_dir, ignored):
    rules = IgnoreRules().add(["*.tmp", "build/", "!important.log", "# remark", "", "docs/**/*.md"])
    assert rules.matches(path, is_dir) is ignored
    if not is_dir:
        got = spark.createDataFrame([(path,)], "p string").select(rules.column(F.col("p")).alias("v")).first().v
        assert got is ignored


def test_python_chunks():
    src = "import os\n\ndef f(a):\n    return g(a)\n\nclass C(Base):\n    def m(self):\n        return f(1)\n    async def n(self):\n        pass\n\nasync def h():\n    await x.y()\n"
    got = chunking.chunk_text("a/b.py", src)
    assert [(k, n) for k, n, *_ in got] == [("function", "f"), ("class", "C"), ("method", "C.m"), ("method", "C.n"), ("function", "h"), ("module", "<module>")]
    assert got[0][5] == ["g"] and got[4][5] == ["x.y"]
    assert [c[0] for c in chunking.chunk_text("bad.py", "def f(:\n")] == ["raw"]


def test_other_chunks():
    js = "import x from 'y';\n\nexport class A {\n  m() { return 1; }\n}\n\nfunction f() {\n  return {};\n}\nconst g = (a) => a + 1;\n"
    assert [(k, n) for k, n, *_ in chunking.chunk_text("a.ts", js)] == [("class", "A"), ("function", "f"), ("function", "g"), ("module", "<module>")]
    md = "intro\n\n# One\ntext\n## Two\nmore\n"
    assert [n for _, n, *_ in chunking.chunk_text("a.md", md)] == ["<preamble>", "One", "Two"]
    assert [(k, n) for k, n, *_ in chunking.chunk_text("a.json", "{}")] == [("config", "a.json")]
    assert chunking.chunk_text("a.py", "  \n") == []
    big = chunking.chunk_text("a.yaml", "key: value\n" * 400)
    assert [n for _, n, *_ in big] == ["a.yaml[0]", "a.yaml[1]", "a.yaml[2]"]


def test_languages_with_braces():
    go = 'package x\n\ntype S struct {\n\tA int\n}\n\nfunc (s *S) Run(n int) error {\n\tif n > 0 {\n\t\treturn help(n)\n\t}\n\treturn nil\n}\n\nfunc help(n int) error { return nil }\n'
    got = chunking.chunk_text("a.go", go)
    assert [(k, n) for k, n, *_ in got] == [("class", "S"), ("method", "S.Run"), ("function", "help"), ("module", "<module>")] and got[1][5] == ["help"]
    rust = "use a::b;\n\npub struct P { x: i32 }\n\npub fn run(n: u8) -> u8 {\n    go(n)\n}\n\nstruct Unit;\n"
    assert [(k, n) for k, n, *_ in chunking.chunk_text("a.rs", rust)] == [("class", "P"), ("function", "run"), ("class", "Unit"), ("module", "<module>")]
    java = "package x;\n\npublic class A {\n    public int f(int a) {\n        return g(a);\n    }\n}\n"
    assert [(k, n) for k, n, *_ in chunking.chunk_text("A.java", java)] == [("class", "A"), ("method", "A.f"), ("module", "<module>")]
    c = "#include <a.h>\nstatic int f(int a) {\n  for (;;) { g(a); }\n}\n"
    assert [(k, n) for k, n, *_ in chunking.chunk_text("a.c", c)] == [("function", "f"), ("module", "<module>")]
    assert chunking.chunk_text("a.go", "package x")[0][0] == "raw"


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300))
def test_blocks_hold_every_line(source):
    parts = chunking.split_block(source, "x", 1, 10)
    assert "".join("".join(p[3].split()) for p in parts) == "".join(source.split())


def test_chunking_survives_odd_rows(spark):
    f = spark.createDataFrame([("p", "a.py", "h", "code", "def f(): pass", 1), ("p", None, "h", "code", "x", 1), ("p", "b.py", None, None, None, 1), (None, "c", None, None, "text", 1)], "project_uuid string, relative_path string, file_hash string, category string, content string, chunk_index int")
    assert rows(chunking.chunk_files(f), "source_file", "chunk_type") == [("a.py", "function"), ("c", "raw")]


def test_summaries_with_and_without_a_function(spark):
    c = spark.createDataFrame([("src/a.py", "some text", ["x"]), ("b.py", "other", [])], "source_label string, content string, detected_tags array<string>")
    assert {r.is_dumb_summary for r in summarise.summarise_chunks(c).collect()} == {True}
    good = summarise.summarise_chunks(c, lambda t: '{"summary": "S", "tags": ["y"], "relevance": 0.9}').collect()
    assert all(r.summary == "S" and "y" in r.detected_tags and not r.is_dumb_summary for r in good)
    assert {r.is_dumb_summary for r in summarise.summarise_chunks(c, lambda t: 1 / 0).collect()} == {True}
    group = lambda t: json.dumps({"summaries": [{"index": 0, "summary": "g"}]}) if t.startswith("[") else '{"summary": "own"}'
    assert sorted(r.summary for r in summarise.summarise_grouped(c.coalesce(1), group).collect()) == ["g", "own"]
    l1 = summarise.summarise_directories(summarise.summarise_chunks(c))
    assert summarise.pruned(l1, 0.9).count() == 1
    l2 = summarise.summarise_projects(l1.withColumn("project_uuid", F.lit("p"))).collect()
    assert len(l2) == 1 and l2[0].n_modules == 1 and l2[0].summary.startswith("- [<root>] (relevance=0.04): ")


def test_large_keys_are_summarised_in_steps(spark):
    rows = spark.createDataFrame([("a", i, f"a{i}") for i in range(50)] + [("b", i, f"b{i}") for i in range(3)] + [("c", 1, None)], "k string, n long, text string")
    got = {r.k: r.text for r in summarise.tree_texts(rows, ["k"], "n", fan=7).collect()}
    assert got == {"a": "\n".join(f"a{i}" for i in range(50)), "b": "b0\nb1\nb2"}
    sizes = {r.k: r.text for r in summarise.tree_texts(rows, ["k"], "n", lambda t: str(t.count("\n") + 1), fan=7).collect()}
    assert int(sizes["b"]) == 3 and int(sizes["a"]) <= 7


def test_community_summary_is_asked_only_when_needed(spark):
    com = spark.createDataFrame([("a", "kept", False), ("b", "old", True), ("c", None, False)], SCHEMAS["communities"])
    f = spark.createDataFrame([("2", "two", None, False, "b"), ("1", "one", None, False, "b")], SCHEMAS["files"])
    got = {r.id: (r.summary_text, r.is_dirty) for r in summarise.refreshed_communities(com, f, lambda t: f"<{t}>").collect()}
    assert got == {"a": ("kept", False), "b": ("<one\ntwo>", False), "c": ("<>", False)}


def test_hashed_embeddings():
    v = embed.hashed_embedding("alpha beta")
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-5 and v == embed.hashed_embedding("Alpha  beta") and embed.hashed_embedding("...") is None


def test_facts_add_update_delete_and_noop(spark):
    now = datetime.datetime(2024, 5, 1)
    base = spark.createDataFrame([], SCHEMAS["semantic_facts"])
    new = lambda *t: spark.createDataFrame([("user", " u ", i, x) for i, x in enumerate(t)], "scope_type string, scope_id string, seq long, fact_statement string")
    one, log = facts.decide_facts(base, new("likes tea"), lambda active, s: 1 / 0, now)
    assert [r.action for r in log.collect()] == ["ADD"] and rows(facts.active_facts(one, "user", "u"), "fact_statement") == [("likes tea",)]
    two, log = facts.decide_facts(one, new("likes coffee"), lambda active, s: json.dumps({"action": "UPDATE", "target_id": active[0][0], "updated_statement": "likes both"}), now)
    assert rows(facts.active_facts(two), "fact_statement") == [("likes both",)] and facts.fact_history(two, "user", "u").count() == 2
    gone, _ = facts.decide_facts(two, new("x"), lambda active, s: json.dumps({"action": "DELETE", "target_id": active[0][0]}), now)
    assert facts.active_facts(gone).count() == 0
    for reply, action, n in (("no json", "ADD", 2), ('{"action": "UPDATE", "target_id": 99}', "ADD", 2), ('{"action": "DELETE"}', "NOOP", 1), ('{"action": "ODD"}', "NOOP", 1)):
        out, log = facts.decide_facts(two, new("x"), lambda active, s, reply=reply: reply, now)
        assert (log.first().action, facts.active_facts(out).count()) == (action, n)
    twice, log = facts.decide_facts(base, new("a", "b"), lambda active, s: json.dumps({"action": "UPDATE", "target_id": active[0][0]}), now)
    assert rows(facts.active_facts(twice), "fact_statement") == [("b",)]


def test_fact_writes_feedback_and_time(spark):
    now, later = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    f = facts.insert_facts(spark.createDataFrame([], SCHEMAS["semantic_facts"]), spark.createDataFrame([("user", "u", " x ")], "scope_type string, scope_id string, fact_statement string"), F.lit(now))
    with pytest.raises(ValueError):
        facts.insert_facts(f, spark.createDataFrame([("project", "u", "x")], "scope_type string, scope_id string, fact_statement string"), F.lit(now))
    ended = facts.invalidate_facts(f, spark.createDataFrame([(1,)], "id long"), F.lit(later))
    assert facts.active_facts(ended).count() == 0 and facts.facts_as_of(ended, F.lit(now)).count() == 1 and facts.facts_as_of(ended, F.lit(later)).count() == 0
    u = facts.with_feedback(f, spark.createDataFrame([(1, True), (1, True), (1, False), (1, None), (None, True)], "fact_id long, was_useful boolean")).first()
    assert (u.utility_alpha, u.utility_beta) == (3.0, 2.0)


def test_checkpoints_and_memory(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    log = spark.createDataFrame([("a", "s", "init", '{"n": 1}', t(0), 0), ("a", "s", "loop_1", "{}", t(1), 1), ("a", "s", "loop_2", "{}", t(1), 2), ("b", "s", "init", '{"n": 2}', t(0), 3)], SCHEMAS["agent_checkpoints"])
    assert [r.checkpoint_id for r in facts.checkpoint_timeline(log, "a", "s").collect()] == ["init", "loop_1", "loop_2"]
    assert facts.checkpoint_state(log, "b", "s", "init") == {"n": 2} and facts.checkpoint_state(log, "x", "s", "init") == {}
    m = facts.seeded_memory(spark.createDataFrame([(1, "user", "u", "b", "old", t(0))], SCHEMAS["user_core_memory"]), {("user", "u", "b"): "new", ("org", "o", "c"): "x"}, F.lit(t(5)))
    assert rows(facts.core_memory(m), "block_label", "content") == [("b", "new"), ("c", "x")]
    assert facts.memory_blocks(facts.core_memory(m), "user", "u", "b").first().content == "new"


def test_phrases_and_texts_are_folded_alike(spark):
    from engrama.operators import search

    n = spark.createDataFrame([(1, "Ștefan és főnök", None, None), (2, "ștefan Çağ", None, None), (3, "μέθοδος Ёлка", None, None)], "id long, label string, tags string, summary string")
    t = search.token_frame(n)
    hits = lambda p: rows(search.phrase_matches(t, p), "id")
    assert hits("ştefan") == hits("stefan") == [(1,), (2,)] and hits("főnök") == hits("FONOK") == [(1,)] and hits("cag") == [(2,)] and hits("μεθοδος елка") == hits("Μέθοδος ёлка") == [(3,)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab./*?", min_size=1, max_size=6), st.text(alphabet="ab./", min_size=1, max_size=6))
def test_rules_within_a_name_match_as_globs(pattern, name):
    import fnmatch

    if "/" in pattern or "/" in name or "**" in pattern or pattern.strip(".") == "":
        return
    rules = IgnoreRules(general=[pattern])
    assert rules.matches(name) == fnmatch.fnmatchcase(name, pattern)


def test_scripts_give_calls_and_whole_bodies():
    source = "import { a } from './a';\nexport function one(x) {\n  const s = 'a } b' + `}`;\n  // } not the end\n  return two(x) + lib.three(x);\n}\nconst four = (y) => one(y);\nclass K {\n  m() { return one(1); }\n}\n"
    got = {n: (kind, body, calls) for kind, n, _, _, body, calls in chunking.script_chunks(source, 512)}
    assert got["one"][1].endswith("lib.three(x);\n}") and set(got["one"][2]) >= {"two", "lib.three"} and got["four"][2] == ["one"] and got["K"][0] == "class"
    go = 'package p\n\nfunc Run(x int) {\n\tprint("}")\n\tother(x)\n}\n\nfunc Next() {\n\tRun(1)\n}\n'
    names = {n: calls for _, n, _, _, _, calls in chunking.chunk_text("a.go", go)}
    assert "other" in names["Run"] and names["Next"] == ["Run"]
    assert len(chunking.script_chunks("function f() {\n" * 300 + "}" * 300, 10**9)) == 300
