import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from engrama.llm import splitting as S

LIMITS = "purpose string, category string, max_tokens int, overlap_tokens int, content string"
CHUNKS = "chunk_id long, category string, content string, parsed_at timestamp, piece_index int, max_tokens int"
T = datetime.datetime(2024, 1, 1)


def joined(text, pieces):
    return "".join(text[a + back : b] for a, b, back in pieces)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r\té😀‍#=", max_size=600), st.integers(1, 12), st.integers(-1, 20))
def test_pieces_fit_overlap_and_give_the_text_back(text, most, overlap):
    pieces = S.split_text(text, most, overlap)
    assert joined(text, pieces) == text
    assert all(S.tokens_of(b - a) <= most for a, b, _ in pieces)
    want = 4 * max(0, min(overlap, most // 2))
    assert all(back <= want for _, _, back in pieces)


def test_overlap_is_the_end_of_the_piece_before():
    text = "word " * 200
    pieces = S.split_text(text, 20, 5)
    assert len(pieces) > 1 and all(back == 20 for _, _, back in pieces[1:])
    for (_, end, _), (start, _, back) in zip(pieces, pieces[1:]):
        assert start + back == end


def test_cuts_prefer_definitions_then_paragraphs_then_sentences():
    code = "".join(f"def f{i}():\n    x = {i}\n    return x\n" for i in range(20))
    assert all(code[a + back :].startswith("def ") for a, _, back in S.split_text(code, 40, 0))
    prose = "One sentence here. " * 40
    assert all(prose[:b].rstrip().endswith(".") for _, b, _ in S.split_text(prose, 30, 0))


def test_no_cut_inside_a_cluster():
    text = "é" * 300
    assert all(text[a + back] == "e" for a, _, back in S.split_text(text, 10, 2) if a + back < len(text))
    crlf = "ab\r\n" * 200
    assert all(crlf[a + back - 1 : a + back + 1] != "\r\n" for a, _, back in S.split_text(crlf, 10, 0) if a)


def test_operator_cases(spark):
    big = "x" * 500
    chunks = spark.createDataFrame(
        [(1, "code", "short", T, 9, 9), (2, "code", big, T, 9, 9), (2, "code", big, T, 9, 9), (3, "code", None, T, 9, 9), (4, "code", "", T, 9, 9), (5, "other", big, T, 9, 9), (6, None, big, T, 9, 9), (7, "code", big, T, 9, 9), (7, "code", "now short", T + datetime.timedelta(1), 9, 9), (None, "code", big, None, 9, 9), (8, "doc", big, T, 9, 9)],
        CHUNKS,
    )
    limits = spark.createDataFrame([("split", "code", 50, 8, "c"), ("split", "doc", 50, None, "c"), ("fill", None, 10, None, "c"), ("split", None, 1, 0, "c")], LIMITS)
    pieces = S.split_items(chunks, limits).collect()
    n = {i: sum(p.chunk_id == i for p in pieces) for i in (1, 2, 3, 4, 5, 6, 7, 8, None)}
    assert n[1] == 1 and n[2] > 1 and n[3] == 0 and n[4] == 1 and n[5] == 1 and n[6] == 1 and n[7] == 1 and n[8] > 1 and n[None] > 1
    assert {p.content for p in pieces if p.chunk_id == 7} == {"now short"}
    assert sorted(r.chunk_id is None and -1 or r.chunk_id for r in S.oversized(S.split_items(chunks, limits)).collect()) == [-1, 2, 8]
    assert S.split_items(chunks.limit(0), limits).count() == 0 and S.split_items(chunks, limits.limit(0)).count() == 8
