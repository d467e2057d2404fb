"""Cleaning, chapters and segmentation on small hand-made texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed, kernels
from lectern.functions import text as tx
from lectern.operators import chapters as ch
from lectern.operators import clean as cl
from lectern.operators import rewrite as rw
from lectern.operators import segment as sg


def compact(text):
    return re.sub(r"\s+", "", text)


TEXTS = [
    "他问道：“你到哪里去了？我等了很久。”然后转身离开。" * 60,
    "这段话完全没有任何标点符号只是不停地写下去" * 120,
    "Part 2\nMr. Jones owed 2.75 pounds. He whispered, \"Come along!\"\n\n另起一行。" * 70,
    "序\n「" + "这一句引文实在太长，所以只能从里面断开，" * 80 + "」\n结束了。",
    "！？。只剩标点。\n\n", "b" * 301, "   ", "a. " * 400, "word " * 500, "(nested “quotes” (deep) here.) " * 40, "….\n\n\n   \n" * 200,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("sizes", [(200, 300, 60), (100, 180, 30), (20, 40, 1)])
def test_pieces_are_lossless_and_bounded(text, sizes):
    target, longest, shortest = sizes
    pieces = sg.cut(text, target, longest, shortest)
    assert compact("".join(p[0] for p in pieces)) == compact(text)
    assert all(0 < len(p[0]) <= longest for p in pieces)
    assert all(text[p[1]:p[2]].strip() == p[0] for p in pieces)


def test_quotation_stays_whole():
    quote = "“" + "今晚我们就在桥边见面吧。" * 6 + "”"
    text = "天色渐渐暗了下来。" * 6 + "他说：" + quote + "风停了。" * 12
    assert any(quote in p[0] for p in sg.cut(text, 100, 180, 30))


def test_long_chapter_is_segmented_in_linear_time():
    text = "夜里下了一场小雨，街上没有什么人。\n\n" * 40000
    started = time.perf_counter()
    pieces = sg.cut(text, 200, 300, 60)
    assert time.perf_counter() - started < 15
    assert sum(len(p[0]) for p in pieces) > 0.8 * len(compact(text))


def test_long_runs_of_marks_stay_linear():
    started = time.perf_counter()
    sg.cut("!" * 200_000 + "\n" * 200_000, 200, 300, 60)
    assert time.perf_counter() - started < 10


def test_segment_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = sg.segment_exact(df, "id").orderBy("id", "seg_index").collect()
    for i, text in enumerate(TEXTS):
        assert [(r.text, r.start, r.end, r.boundary) for r in rows if r.id == i] == sg.cut(text, 200, 300, 60)
    assert sg.lossy_chapters(sg.segment_exact(df, "id"), df, "id").isEmpty()
    light = sg.segment_light(df, "id")
    assert sg.lossy_chapters(light, df, "id").isEmpty()
    assert light.filter(F.length("text") > 301).isEmpty()


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        sg.exact_pieces(400, 300, 60)


def test_cleaning_keeps_meaning(spark):
    raw = "﻿他说：‘共2.50元……’\r\n[42] Words https://example.org/x\x00\x07"
    row = cl.clean(spark.createDataFrame([(raw,)], "text string")).first()
    assert all(part in row.text for part in ("2.50", "……", "[42]", "https://example.org/x", "Words"))
    assert "\x00" not in row.text and "﻿" not in row.text
    assert [a.operation for a in row.audit] == ["remove_controls", "format_cleanup"]
    assert row.audit[0].n == 3


def test_inline_markup_adds_no_spaces(spark):
    html = "<body><div><p>他<b>慢慢<i>走</i></b>了。</p><p>下一段<br/>还有。</p></div><script>var x='</p>'</script></body>"
    row = spark.createDataFrame([(html,)], "h string").select(
        tx.html_to_text(F.col("h")).alias("a"), kernels.html_text_strict(F.col("h")).alias("b")).first()
    for text in row:
        assert text.count("他慢慢走了。") == 1 and "下一段\n还有。" in text and "var" not in text


def test_marked_header_in_the_middle(spark):
    text = "intro\n<=== Shaft Novel Start ===>\nTitle: T\nTags: x\nprose\n<=== Shaft Novel End ===>\nend\n<===Shaft Novel Start===>\n\nBody:\nmore"
    row = cl.strip_source_header(spark.createDataFrame([(text,)], "text string")).first()
    assert row.text == "intro\nprose\nend\nmore"
    assert row.audit[0].extra == {"title": "T"}


def test_header_needs_title_author_and_site(spark):
    fields = "标题：甲\n作者：乙\n简介：丙\n"
    rows = [(1, fields + "正文开始"), (2, fields + "小说链接：https://www.pixiv.net/novel/1\n正文：剩下的\n作者：留下"),
            (3, "Title: a\nTags: https://www.pixiv.net/x\nTags: b\nprose")]
    found = {r.id: r for r in cl.strip_source_header(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1] and not found[1].audit
    assert found[2].text == "剩下的\n作者：留下"
    assert found[2].audit[0].extra == {"title": "甲", "author": "乙"}


def test_urls(spark):
    text = "看 https://a.example.com/x?y=1。 www.b.org, [文字](http://c.example.net/d) [http://e.f](http://g.h/i)!\nexample.com\nexample.com is a site"
    row = cl.remove_urls(spark.createDataFrame([(text,)], "text string")).first()
    assert row.text == "看 。 , 文字 !\nexample.com is a site"
    assert row.audit[0].removed == ["http://c.example.net/d", "http://g.h/i", "https://a.example.com/x?y=1", "www.b.org", "example.com"]


def test_a_line_is_taken_apart_once(spark):
    """A domain line's parts are named, not written out wherever they are used; a plan that grew was worked out as often."""
    judged = spark.createDataFrame([("a\nb.com",)], "t string").select(F.filter(tx.lines("t"), cl.is_domain_line).alias("d"))
    plan = judged._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("lower(") == 1 and judged.first().d == ["b.com"]


def test_patterns_that_begin_with_a_class_find_the_same(spark):
    import random
    rnd = random.Random(3)
    parts = ["\r", "\n", "\r\n", "\x0b", "\x85", "\u2028", "a", "H", "h", "ttp", "ttps", "TTP", "://", "ww.", "w", "W", "www.", "http://", "x.y", "é", " ", "ſ", ".", ",", "-", "]", "%Z9", "\u2029"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    old_url = (r"(?i)(?:https?://|www\.)[a-z0-9]"
               r"(?:[a-z0-9._~:/?#\[\]@!$&()*+,;=%-]*[a-z0-9_~:/#\[\]@$&(*+=%-])?")
    old_breaks = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.select(F.split("t", fixed.LINE_BREAKS, -1) == F.split("t", old_breaks, -1),
                     cl.inline_urls(F.col("t")) == F.regexp_extract_all("t", F.lit(old_url), F.lit(0)), F.size(cl.inline_urls(F.col("t"))),
                     tx.lines("t") == tx.let(F.split("t", old_breaks, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)))
    rows = same.collect()
    assert all(r[0] and r[1] and r[3] for r in rows) and sum(r[2] for r in rows) > 100


def test_line_separators(spark):
    cases = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc d\x0be\x85f"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", tx.lines("t").alias("l"))
    for row in df.collect():
        assert row.l == cases[row.i].splitlines()


def test_default_chapter_pattern(spark):
    text = "前面的话。\n第十二章 重逢\n内容一。\n第3回 分别\n内容二。\nchapter 4 Home\nThe end.\n" + "第一章" + "长" * 120
    rows = ch.split_chapters(spark.createDataFrame([(text,)], "text string"), F.lit("书")).orderBy("chapter_index").collect()
    assert [r.title for r in rows] == ["书", "第十二章 重逢", "第3回 分别", "chapter 4 Home"]
    assert rows[1].text == "第十二章 重逢\n内容一。"


def test_excluded_chapters(spark):
    chapters = spark.createDataFrame([("## A", "x"), ("## B", "ads")], "title string, text string")
    kept, gone = ch.exclude_chapters(chapters, [r"^## B$"])
    assert [r.title for r in kept.collect()] == ["## A"] and [r.text for r in gone.collect()] == ["ads"]


def test_selection_strings(spark):
    specs = ["1,3-5", " 2 - 4 , 9", "5-3", "0", "a", "", "1-", "1000001", "3,3,3"]
    df = spark.createDataFrame(list(enumerate(specs)), "i int, spec string")
    found = {}
    for row in ch.parse_selection(df, "spec", "i").collect():
        found.setdefault(row.i, set()).add(row.chapter_index)
    assert found == {0: {1, 3, 4, 5}, 1: {2, 3, 4, 9}, 8: {3}}


def test_terms_are_replaced_once(spark):
    terms = {"cat": "dog", "dog": "cat", "catalog": "list", "a.b": "dot"}
    df = spark.createDataFrame([(1, "a cat catalog dog a.b axb\ncat")], "id int, text string")
    row = rw.spoken_text(df, terms).first()
    assert row.spoken_text == "a dog list cat dot axb\ndog" and row.error is None
    counts = {r.source: r["count"] for r in rw.replacement_counts(df, terms, "id").collect()}
    assert counts == {"cat": 2, "catalog": 1, "dog": 1, "a.b": 1}
    with pytest.raises(ValueError):
        rw.replace_terms(F.col("text"), {" ": "x"})


def test_names(spark):
    cases = ["a/b:c?", "CON", "com1.txt", "  ..x.. ", "...", "x" * 80, "console"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, n string").select("i", tx.safe_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in sorted(rows)] == ["a_b_c_", "_CON", "_com1.txt", "x", "book", "x" * 60, "console"]


def test_clock(spark):
    cases = [0.0, 59.9, 61.0, 3661.0, -1.0, float("nan"), None]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, s double").select("i", tx.clock(F.col("s")).alias("c")).collect()
    assert [r.c for r in sorted(rows)] == ["0:00", "0:59", "1:01", "1:01:01", "—", "—", "—"]


def test_settings_are_closed_and_checked(spark):
    from lectern import settings
    assert settings.load(settings.SegmentSizes, {"target": 100, "shortest": 30}).longest == 300
    for kind, values in [(settings.SegmentSizes, {"targett": 1}), (settings.SegmentSizes, {"target": 400, "longest": 200}),
                         (settings.QualityRules, {"max_cer": 2}), (settings.QualityRules, {"silence_db": -5}), (settings.DeliverySettings, {"speech_rate": 2})]:
        with pytest.raises(ValueError):
            settings.load(kind, values)
    settings.check_patterns(spark, [r"^\p{L}+$"])
    with pytest.raises(ValueError):
        settings.check_patterns(spark, ["(open"])


def test_no_text_overflows_the_stack(spark):
    """Patterns with a repeated group nest as deep as a text is long; these two are long."""
    mixed = spark.createDataFrame([("x\U0001F600" * 50_000 + "the die",)], "text string")
    out = mixed.select(rw.replace_terms(F.col("text"), {"the": "THE", "die": "das"})).first()[0]
    assert out == "x\U0001F600" * 50_000 + "THE das"
    lines = spark.createDataFrame([("a." * 50_000,), ("a." * 50_000 + "com",), ("www.example.org:80/x?y=1",), ("example.org trailing",), ("-a.com",), ("com",), ("a..com",)], "line string")
    assert [r[0] for r in lines.select(cl.is_domain_line(F.col("line"))).collect()] == [False, True, True, False, False, False, False]


def test_fold_agrees_with_single_characters(spark):
    import unicodedata
    texts = ["Σίσυφος ΟΔΟΣ", "ﬁne_print ½ Ⅷ", "İstanbul", "你好，世界", "a-b_c"]
    want = ["".join(c.lower() for c in unicodedata.normalize("NFKC", t) if c.isalnum()) for t in texts]
    from lectern.functions import kernels
    found = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", kernels.fold_compatible("t").alias("f")).orderBy("i").collect()
    assert [r.f for r in found] == want
