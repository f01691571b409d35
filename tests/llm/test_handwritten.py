import datetime
import random

from engrama.llm import handwritten as H

T = datetime.datetime(2024, 1, 1)
CRAWL = "file_id long, project_uuid string, relative_path string, category string, extension string, size_bytes long, existing_node_id long, crawled_at timestamp, node_id long"
NODES = "id long, project_uuid string, label string, type string, content string, loaded_at timestamp, path string"


def code(rng, n=12):
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    return "\n".join(f"def {name()}(x, {name()}):\n    return {name()}(x, {rng.randrange(9)}) + {name()}" for _ in range(n))


def run(spark, files, crawl_more=(), nodes_more=()):
    crawl = [(i, p, path, "code", None, None, i, T, 5) for i, p, path, _ in files] + list(crawl_more)
    nodes = [(i, p, path, "file", text, T, "x") for i, p, path, text in files] + list(nodes_more)
    return {r.file_id: r for r in H.not_handwritten(spark.createDataFrame(crawl, CRAWL), spark.createDataFrame(nodes, NODES)).collect()}


def test_each_kind(spark):
    rng = random.Random(1)
    lib = code(rng)
    patched = lib.replace("return", "yield", 1) + "\n# local remark"
    files = [
        (1, "a", "src/x.py", lib), (2, "b", "y/z.py", "# Other header\n" + lib), (3, "c", "q.py", patched), (4, "d", "own.py", code(rng)), (5, "d", "own2.py", lib[:200]),
        (6, "d", "gen.ts", "// Code generated by tool 1.2. DO NOT EDIT.\nexport const a = 1;"), (7, "d", "hand.ts", "// not auto-generated: keep in step by hand\nexport const a = b;"),
        (8, "d", "m.js", "var a=b(1);if(c){d(e)}" * 60), (9, "d", "t.c", "static const float d[] = {\n" + ",\n".join("0.5, -1.25, 3.0" for _ in range(60)) + "\n};"), (10, "d", "b.py", 'B = "' + "Ab9+" * 300 + '"'),
        (11, "d", "vendor/lib/index.js", "var x = 1;"), (12, "d", "vendor_api/index.js", "var x = 1;"), (13, "d", "c.sh", "\n".join(f"key_{i}={i * 7}" for i in range(20))), (14, "d", "k.js", "const pub = `-----BEGIN PUBLIC KEY-----" + "A" * 900 + "-----END PUBLIC KEY-----`;\nuse(pub);"),
    ]
    got = run(spark, files)
    kinds = {i: {k for k in ("generated", "minified", "data", "vendored") if r[k]} for i, r in got.items()}
    assert all("vendored" in kinds[i] for i in (1, 2, 3, 11)) and not any(kinds[i] for i in (4, 5, 7, 12, 14)), kinds
    assert "generated" in kinds[6] and "generated" in kinds[13] and "minified" in kinds[8] and "data" in kinds[9] and "data" in kinds[10]


def test_two_repositories_are_too_few_and_one_may_hold_many(spark):
    lib = code(random.Random(2))
    got = run(spark, [(i, "ab"[i % 2].upper() if i % 3 else f" {'ab'[i % 2]} ", f"f{i}.py", lib) for i in range(40)])
    assert not any(r.vendored for r in got.values())


def test_cases(spark):
    more = [
        (20, "p", "dist\\bundle.min.js", "code", ".js", None, None, T, 5), (21, "p", "a\\b.py", "code", None, 0, None, T, 5), (22, "p", "doc.md", "doc", None, 0, None, T, 5), (23, None, None, "code", None, None, 999, None, 5),
        (24, "p", "old.py", "code", None, None, None, T, 5), (24, "p", "vendor/old.py", "code", None, None, None, T + datetime.timedelta(1), 5), (None, "p", "x.py", "code", None, None, None, T, 5), (25, "p", "long.py", "code", None, None, 25, T, 5),
    ]
    text = "# This file was produced by the wire compiler 1.2\nx = 1"
    got = run(spark, [], more, [(30, "P", "a/b.py", "file", text, T, "x"), (25, "p", "long.py", "file", code(random.Random(3), 4000), T, "x"), (25, "p", "long.py", "file", None, None, "x"), (None, "p", "z", "file", "t", T, "x")])
    assert set(got) == {20, 21, 23, 24, 25}
    assert got[20].generated and got[21].generated and not got[23].vendored and got[24].vendored and not got[25].vendored
    assert run(spark, []) == {}


def test_fingerprints_survive_layout_and_short_texts():
    c = code(random.Random(5))
    assert set(H.fingerprints(c)) == set(H.fingerprints(c.replace("    ", "\t").replace("\n", "\r\n")))
    assert len(H.fingerprints("a b c")) == 0 and len(H.fingerprints("")) == 0


def test_records_written_as_code_are_data():
    rng = random.Random(8)
    row = lambda: f'{{"id": {rng.randrange(10**6)}, "tag": "{rng.choice(["frame", "edge", "scope"])}", "w": {rng.random():.4f}, "k": "{rng.getrandbits(32):08x}"}}'
    rows = [row() for _ in range(40)]
    inserts = "\n".join(f"INSERT INTO {rng.choice(['edge', 'frame', 'node'])}_rows VALUES ({i}, '{rng.getrandbits(48):012x}', {rng.random():.6f});" for i in range(30))
    bare = "export const rows = [" + ",\n".join(f"{{id: {i}, tag: 'x y', on: true}}" for i in range(40)) + "];"
    pretty = "ROWS = [\n" + ",\n".join(r.replace("{", " {\n  ").replace(", ", ",\n  ").replace("}", "\n }") for r in rows) + "\n]\n"
    columns = inserts.replace(" VALUES", " (id, k, w) VALUES")
    for text in ("ROWS = [" + ", ".join(rows) + "]\n", "module.exports = [" + ", ".join(rows) + "];", pretty, inserts, columns, bare):
        assert H.traits(text)[2], text[:120]
    selects = "\n".join(f"INSERT INTO a_rows SELECT id, k FROM b_rows WHERE kind = '{k}' AND id > {k * 7};" for k in "abcdefghijkl")
    for text in (code(rng, 40), selects, "\n".join(f'    assert parse("{w}", {i}) == render({w}, "{i}")' for i, w in enumerate(["frame", "edge", "scope"] * 9))):
        assert not H.traits(text)[2], text[:120]


def test_lines_that_repeat_with_other_strings_and_hex_are_generated():
    rng = random.Random(9)
    text = "\n".join(f"add_row('{rng.choice(['frame', 'edge'])}', '{rng.getrandbits(48):012x}', {i}, 0x{rng.getrandbits(32):08x});" for i in range(12))
    assert H.traits(text)[0]


def test_marks_count_on_comments_anywhere_but_not_in_strings_or_prose():
    rng = random.Random(10)
    licence = "".join(f"# Permission is granted to use part {i} of this software for any purpose.\n" for i in range(60))
    body = code(rng, 30)
    generated = lambda t: H.traits(t)[0]
    assert len(licence) > 3000 and generated(licence + "\n# Code generated by stubs 1.2. DO NOT EDIT.\n" + body) and generated(body + "\n# Code generated by stubs 1.2. DO NOT EDIT.\n")
    assert generated("/*\n" + licence.replace("#", " *") + " * @generated\n */\n" + body) and generated("import os\n" + body + "\n# This file was automatically generated.\n" + body)
    assert H.traits(body + "\n# copied from the zlib distribution; patches go upstream\n")[3]
    mark = "# Code generated by stubs 1.2. DO NOT EDIT."
    for text in (f'{body}\nHEAD = "{mark}"\n', f'{body}\nHEAD = """\n{mark}\n"""\n', f"const t = `\n// {mark[2:]}\n`;\nuse(t);\n", f"cat > out.py <<'EOF'\n{mark}\nEOF\necho done\n", f"{body}\n# The ids here are automatically generated.\ndef ids():\n    return 1\n", f"def f():\n    {mark[:24]} the compiler 1.2\n    return 1\n"):
        assert not generated(text), text[-200:]
    assert not H.traits(f'{body}\nNOTICE = "copied from the zlib distribution"\n')[3]


def test_short_copies_count_when_all_of_them_recurs(spark):
    rng = random.Random(11)
    tiny, short, own = code(rng, 2), code(rng, 4), code(rng, 2)
    assert 15 <= len(H.TOKEN.findall(tiny)) < 60 < len(H.TOKEN.findall(short)) < 100 and 0 < len(H.fingerprints(short)) and len(H.fingerprints("x = 1")) == 0
    files = [(3 * k + i, "abc"[i], f"f{k}.py", t) for k, t in enumerate((tiny, short, "import os\n")) for i in range(3)] + [(20, "a", "own.py", own), (21, "a", "g.py", tiny), (22, "d", "two.py", own)]
    got = {i for i, r in run(spark, files).items() if r.vendored}
    assert got == {0, 1, 2, 3, 4, 5, 21}
