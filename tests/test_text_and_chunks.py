import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions import text as X
from corpusloom.operators import chunking as C


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first().x


def test_hashes():
    assert hashing.fnv_of(["", "a", "abc", "🎉"]) == ["811c9dc5", "e40c292c", "1a47e90b", "682eae76"]
    assert hashing.fnv_of([]) == []


def test_document_id(spark):
    assert one(spark, X.document_id("c0"), "a.md") == "doc_ec1ecbe67de859f8"


@pytest.mark.parametrize(("raw", "want"), [("<p>a  b\t c</p>", "a b c"), ("a\n\n\n\nb", "a\n\nb"), ("　 x ﻿", "x"), ("", "")])
def test_clean(spark, raw, want):
    assert one(spark, X.clean_text("c0"), raw) == want


@pytest.mark.parametrize(("raw", "want"), [("---\nkey: 1\n---\nbody", "body"), ("---\nno key\n---\nbody", "---\nno key\n---\nbody"), ("﻿---\r\n\r\n---\r\nx", "x"), ("text", "text")])
def test_front_matter(spark, raw, want):
    assert one(spark, X.strip_front_matter("c0"), raw) == want


def test_tokens(spark):
    assert one(spark, X.tokens("c0"), "AB 3.5% 中 中文字 K") == ["ab", "3.5%", "k", "中", "中文", "文字"]
    assert one(spark, X.count_tokens("c0"), "ab 1.5 中文") == 4
    assert one(spark, X.utf16_length("c0"), "a🎉") == 3


def test_sentences(spark):
    assert one(spark, X.sentences("c0"), "一。二！ \n\n three; four") == ["一。", "二！", " three;", " four"]
    assert one(spark, X.cited_sentences("c0"), "甲。[1]\n乙。[2] 丙") == ["甲。[1]\n", "乙。[2]", "丙"]
    assert one(spark, X.cited_sentences("c0"), "[1] first; second") == ["[1] first;", " second"]


@pytest.mark.parametrize(("raw", "want"), [("<think>a</think> b", "b"), ("x <think>never ends", "x"), ("no tags ", "no tags"), ("a</think>b", "ab")])
def test_think(spark, raw, want):
    assert one(spark, X.strip_think("c0"), raw) == want


def test_overlap(spark):
    assert one(spark, X.overlap_length(F.col("c0"), F.col("c1")), "abcab", "cabx") == 3
    assert one(spark, X.without_overlap(F.col("c0"), F.col("c1")), "abc", "xyz") == "abcxyz"


def test_markdown():
    raw = "﻿---\na: b\n---\n# T <!-- c -->\r\np1\n p2 \n\n### deep\ntext\n####### seven\n#no\n"
    got = [(b["type"], b["text"], b["heading_path"]) for b in C.markdown_parts(raw)]
    assert got == [("heading", "T", ["T"]), ("text", "p1\np2", ["T"]), ("heading", "deep", ["T", None, "deep"]), ("text", "text\n####### seven\n#no", ["T", None, "deep"])]


def text_block(t, path=()):
    return {"text": t, "page": 1, "heading_path": list(path), "type": "text"}


def test_packing():
    o = C.ChunkOptions(max_tokens=6, min_chars=5, max_chars=100, sentence_overlap=1)
    chunks = C.pack([text_block("a b;c d;e f;g h;i j;")], o)
    assert [c["content"] for c in chunks] == ["a b;c d;e f;", "e f;g h;i j;"]
    assert (chunks[1]["char_start"], chunks[1]["char_end"], chunks[1]["token_count"]) == (8, 20, 6)
    heading = {"text": "H", "page": 1, "heading_path": ["H"], "type": "heading"}
    two = C.pack([text_block("aaaa bbbb"), heading, text_block("x", ["H"])], o)
    assert [c["content"] for c in two] == ["aaaa bbbbx"] and two[0]["heading_path"] == []
    assert C.pack([heading], o) == [] and C.pack([], o) == []
    long = C.pack([text_block("x" * 250)], C.ChunkOptions(max_tokens=256, min_chars=10, max_chars=100))
    assert [len(c["content"]) for c in long] == [100, 100, 50]


def test_bad_options():
    for bad in ({"max_tokens": 0}, {"min_chars": 600}, {"sentence_overlap": -1}):
        with pytest.raises(ValueError):
            C.ChunkOptions(**bad)


def test_links_and_partitions(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{j}." for j in range(i * 40)) + "\nend;") for i in range(6)], "doc_id long, text string")

    def run(n):
        rows = C.link_chunks(C.chunk_documents(C.text_blocks(docs.repartition(n))), "v").collect()
        return sorted((r.doc_id, r.ord, r.content_hash, r.chunk_id, r.prev_id, r.next_id, r.parent_id) for r in rows)

    assert run(1) == run(4) == run(17)
    assert all(r[5] == "" or r[5].startswith("v:" + r[0]) for r in run(1))


# Inputs and, for each chunk, ord, hash, start, end (in UTF-16 units) and tokens.
EXPECTED = {
    "headings": ("# 车窗清洁\r\n\r\n清洁车窗时使用中性清洁剂。\r\n\r\n## 频率\r\n\r\n每周一次，雨季加密到每周两次。\r\n", [(0, "402a5840", 0, 28, 25)]),
    "skipped level": ("### 第三章 设备维护\n\n本章说明维护流程。日常巡检每班一次，记录在值班表上。\n\n##### 3.1.2 润滑\n\n轴承润滑周期为 2000 小时。加注量以油标中线为准。\n", [(0, "3961ef20", 0, 53, 43)]),
    "long sentence": (f"超长句硬切测试。\n\n{'设备运行期间需要持续监测振动与温度并记录相关数据' * 29}设备运行。\n\n结尾一句用于验证硬切后的收尾。\n", [(0, "2aa65a89", 0, 8, 7), (1, "7363941e", 8, 608, 600), (2, "a1b33d72", 608, 724, 114)]),
    "two units a sign": ("# 非 BMP 字符\n\n验收通过后请佩戴徽章 🎉 并记录乐谱记号 𝄞 的位置。\n\n混合 English 与 2026 年 10 月 12 日日期。\n", [(0, "919d8068", 0, 61, 32)]),
    "short tail": ("# 维护清单\n\n" + "".join(f"维护项目第{i}项要求按期执行并留存记录。" for i in range(1, 13)) + "\n\n（此处为一句较短的收尾说明，用于触发尾部残块并入。）\n", [(0, "eabec57c", 0, 257, 238)]),
    "headings only": ("# a\n\n## b\n", []),
    "empty": ("", []),
}


def test_expected_chunks(spark):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in EXPECTED.items()], "doc_id string, text string")
    got = {}
    for r in C.chunk_documents(C.markdown_blocks(docs)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.content_hash, r.char_start, r.char_end, r.token_count))
    assert got == {n: chunks for n, (_, chunks) in EXPECTED.items() if chunks}


def test_sizes_in_one_pass(spark):
    docs = C.text_blocks(spark.createDataFrame([(i, " ".join(f"word{j}." for j in range(i * 60))) for i in range(5)], "doc_id long, text string"))
    sizes = [8, 32, 256]
    got = sorted((r.max_tokens, str(r.doc_id), r.ord, r.content, r.token_count) for r in C.chunk_sizes(docs, sizes).collect())
    want = sorted((s, r.doc_id, r.ord, r.content, r.token_count) for s in sizes for r in C.chunk_documents(docs, C.ChunkOptions(max_tokens=s)).collect())
    assert got == want
    assert {(r.max_tokens, r.chunks) for r in C.sweep_sizes(docs, sizes).collect()} == {(s, sum(w[0] == s for w in want)) for s in sizes}


def test_rows_of_long_documents_are_handed_on_before_the_batch_ends():
    seen = []

    def packed():
        for i in range(6):
            seen.append(i)
            yield [i] * 3

    parts = C._held(packed(), most=5)
    assert next(parts) == [0, 0, 0, 1, 1, 1] and seen == [0, 1]
    assert [x for p in parts for x in p] == [i for i in range(2, 6) for _ in range(3)]


def test_sizes_are_swept_without_texts(spark):
    docs = C.text_blocks(spark.createDataFrame([(1, "Ein Satz. " * 300), (2, "")], "doc_id long, text string"))
    bare, full = (C.chunk_sizes(docs, [128, 256], texts=t).collect() for t in (False, True))
    key = lambda r: (r.max_tokens, r.doc_id, r.ord, r.token_count)
    assert sorted(map(key, bare)) == sorted(map(key, full)) and {r.content for r in bare} == {None}
