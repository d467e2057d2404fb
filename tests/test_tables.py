"""EPUB tables, sources, identities, quality, state, work and skew."""

import hashlib
import io
import json
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import identity as idf
from lectern.functions import kernels
from lectern.operators import cache, clips, epub, order, quality, rollup, scan, work
from lectern.sources import readers
from lectern.streaming import jobs as st


def test_reading_order_sections_and_audit(spark):
    spine = spark.createDataFrame([(1, 0, "nav", None), (1, 1, "a", None), (1, 2, "b", None), (1, 3, "a", None), (1, 4, "c", None),
                                   (1, 5, "d", None), (1, 6, "e", "no"), (1, 7, "f", None)], "book_id int, pos int, item string, linear string")
    docs = spark.createDataFrame([
        (1, "b", "b.xhtml", "", "<h1>乙章</h1><p>内容乙。</p>"), (1, "a", "a.xhtml", "", "<h1>甲章</h1><p>内容甲。</p>"),
        (1, "nav", "nav.xhtml", "nav", "<a>x</a>"), (1, "e", "e.xhtml", "", "<p>side</p>"), (1, "f", "f.xhtml", "", "<img src='x'/>"),
        (1, "c", "all.xhtml", "", '<p>before</p><h2 id="s1">起</h2><p>第一部分。</p><h2 id="s2">止</h2><p>第二部分。</p>'),
        (1, "d", "d.xhtml", "", "<div>no paragraph</div>")], "book_id int, item string, name string, properties string, html string")
    toc = spark.createDataFrame([(1, 0, "all.xhtml#s1", "起"), (1, 1, "all.xhtml#s2", "止"), (1, 2, "all.xhtml#gone", "x")],
                                "book_id int, pos int, href string, title string")
    chapters, audit = epub.assemble(spine, docs, toc)
    rows = chapters.orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.title) for r in rows] == [(1, "甲章"), (2, "乙章"), (3, "起"), (4, "起"), (5, "止"), (6, "Chapter 6")]
    assert rows[2].text == "before" and "第一部分" in rows[3].text and "第二部分" in rows[4].text
    seen = {(r.source, r.operation) for r in audit.collect()}
    assert {("a.xhtml", "skip_repeated_spine_item"), ("nav.xhtml", "skip_navigation_or_non_linear"), ("e.xhtml", "skip_navigation_or_non_linear"),
            ("f.xhtml", "skip_image_only_or_empty"), ("all.xhtml", "missing_toc_anchor"), ("d.xhtml", "review_non_paragraph_document")} <= seen


def container(html: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as box:
        box.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='p.opf'/></rootfiles></container>")
        box.writestr("p.opf", "<package><metadata><title>T</title><meta name='cover' content='i'/></metadata><manifest>"
                              "<item id='a' href='a.xhtml' media-type='application/xhtml+xml'/><item id='i' href='c.png' media-type='image/png'/>"
                              "</manifest><spine><itemref idref='a' linear='no'/></spine></package>")
        box.writestr("a.xhtml", html)
        box.writestr("c.png", b"\x89PNG")
    return buffer.getvalue()


def test_files_encodings_and_containers(spark, tmp_path):
    text = "序言。\n第一章 开始\n正文。"
    (tmp_path / "A.TXT").write_bytes(text.encode("utf-8-sig"))
    (tmp_path / "b.txt").write_bytes(text.encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(text.encode("utf-16"))
    (tmp_path / "ignore.md").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.EPUB").write_bytes(container("<p>x</p>"))
    (tmp_path / "sub" / "broken.epub").write_bytes(b"not a zip")
    flat = readers.discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in readers.listing(flat).collect()] == ["A.TXT", "b.txt", "c.txt"]
    decoded, bad = readers.decode_text(flat)
    assert {(r.text, r.encoding) for r in decoded.collect()} == {(text, "utf-8"), (text, "gb18030"), (text, "utf-16")}
    assert bad.isEmpty()
    everything = readers.discover(spark, str(tmp_path), recursive=True)
    tables = readers.read_epub(everything)
    assert [r.html for r in tables["docs"].collect()] == ["<p>x</p>"]
    assert [r.linear for r in tables["spine"].collect()] == ["no"]
    assert [r.media_type for r in tables["images"].collect()] == ["image/png"]
    assert [r.cover_item for r in tables["covers"].collect()] == ["i"]
    assert [r.book_id.endswith("broken.epub") for r in tables["errors"].collect()] == [True]
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        readers.discover(spark, str(tmp_path / "none"))


def test_strict_encoding(spark):
    df = spark.createDataFrame([(1, "é".encode("latin-1")), (2, b"ok")], "id int, content binary")
    good, bad = readers.decode_text(df, "utf-8")
    assert [r.id for r in good.collect()] == [2] and [r.id for r in bad.collect()] == [1]


def test_digest_equals_canonical_json(spark):
    value = {"text": "引号\" 反斜\\ \n\t é", "n": 7, "flag": True, "none": None}
    canonical = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    row = spark.range(1).select(
        idf.digest(text=F.lit(value["text"]), n=F.lit(7), flag=F.lit(True), none=F.lit(None).cast("string")).alias("d"),
        idf.digest_string(F.lit(value["text"])).alias("s")).first()
    assert row.d == hashlib.sha256(canonical.encode()).hexdigest() == idf.digest_literal(value)
    assert row.s == idf.digest_literal(value["text"])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé字") for _ in range(rng.randint(0, 9))) for _ in range(2))
        insertions, deletions, substitutions = kernels.edit_counts(a, b)
        assert insertions + deletions + substitutions == levenshtein(a, b)
        assert insertions - deletions == len(b) - len(a) and min(insertions, deletions, substitutions) >= 0


def test_compare_text(spark):
    df = spark.createDataFrame([("Ｈｅｌｌｏ， Wörld！", "hello wörld"), ("abcd", "ab"), ("", "x")], "r string, h string")
    rows = {r.r: r for r in quality.edit_ops(quality.compare_text(df, "r", "h")).collect()}
    assert rows["Ｈｅｌｌｏ， Wörld！"].cer == 0 and rows["Ｈｅｌｌｏ， Wörld！"].similarity == 1
    assert rows["abcd"].cer == 0.5 and rows["abcd"].deletions == 2
    assert rows[""].cer == 1.0


def test_silent_and_tonal_clips(spark):
    import math
    tone = [math.sin(i * 0.2) * 0.5 for i in range(48000)]
    rows = [("silence", [0.0] * (5 * 2400), 2400, 1, 40), ("tone", tone, 24000, 1, 20), ("empty", [], 24000, 1, 5), ("short", tone[:2400], 24000, 1, 9),
            ("nan", [0.1, float("nan")], 24000, 1, 1)]
    df = spark.createDataFrame(rows, "id string, samples array<double>, rate int, channels int, chars int")
    found = {r.id: r for r in quality.check_clips(df).collect()}
    assert found["silence"].reasons == ["silent_audio", "long_silence"] and abs(found["silence"].max_silence_seconds - 5) < 1e-9
    assert found["tone"]["pass"] and found["tone"].duration == 2
    assert found["empty"].reasons == found["nan"].reasons == ["empty_or_nonfinite_audio"]
    assert found["short"].reasons == ["too_short", "possible_missing_text_or_too_short"]


def test_trim_pads_and_measures(spark):
    samples = [0.0] * 1000 + [0.5] * 2000 + [0.0] * 1000
    row = clips.trim_edges(spark.createDataFrame([(samples, 1000)], "samples array<double>, rate int")).first()
    assert (row["first"], row["last"], row.too_short) == (850, 3150, False)


def test_state_verdicts(spark):
    state = spark.createDataFrame([
        ("a", "completed", 1, "p", "h"), ("b", "completed", 1, "old", "h"), ("c", "completed", 1, "p", "other"), ("d", "failed", 4, "p", None),
        ("e", "failed", 4, "old", None), ("f", "failed", 2, "p", None), ("g", "running", 1, "p", None)],
        "segment_id string, status string, attempts int, qc_hash string, content_sha256 string")
    plan = spark.createDataFrame([(x,) for x in "aabcdefgh"], "segment_id string")
    files = spark.createDataFrame([(x, "h") for x in "abc"], "segment_id string, sha256 string")
    found = {r.segment_id: (r.verdict, r.occurrences) for r in cache.classify_segments(plan, state, files, "p").collect()}
    assert found == {"a": ("cached", 2), "b": ("recheck", 1), "c": ("pending", 1), "d": ("exhausted", 1), "e": ("pending", 1), "f": ("pending", 1),
                     "g": ("pending", 1), "h": ("pending", 1)}
    retried = cache.classify_segments(plan, state, files, "p", retry_failed=True).filter("segment_id = 'd'").first()
    assert retried.verdict == "pending"


def test_summary_of_a_book_without_a_plan(spark):
    fields = "book int, segment_id string, status string, qc_pass boolean, cer double, retry_count int, duration double, generation_seconds double, chars int"
    state = spark.createDataFrame([(1, "a", "completed", True, 0.1, 0, 2.0, 1.0, 10), (1, "x", "completed", True, 0.5, 1, 9.0, 9.0, 99),
                                   (2, "a", "completed", None, None, 0, 2.0, 1.0, 10)], fields)
    plan = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "book int, segment_id string")
    rows = {r.book: r for r in rollup.state_summary(state, plan, "book").collect()}
    assert (rows[1].completed, rows[1].total, rows[1].audio_seconds, rows[1].synthesized_audio_seconds, rows[1].percent) == (2, 3, 4.0, 2.0, 66.7)
    assert (rows[2].completed, rows[2].total, rows[2].percent, rows[2].mean_cer) == (1, 0, 0.0, None)


def test_faulty_items_are_isolated(spark):
    items = spark.createDataFrame([(i, f"text {i}" if i != 13 else "bad") for i in range(1, 41)], "i int, text string").withColumn("c", F.lit(1))
    batched = work.plan_batches(items, ["c"], "i", F.length("text"), 8)

    def scorer(texts):
        if len(texts) > 5 or "bad" in texts:
            raise RuntimeError("no")
        return [1.0] * len(texts)

    rows = work.score_batches(batched, scorer, ["c", *work.BATCH_KEY], "i", order="i").collect()
    assert len(rows) == 40 and len({r.item_id for r in rows}) == 40
    assert [r.item_id for r in rows if r.error] == ["13"]
    assert max(r.call_size for r in rows) <= 5


def test_scorer_with_wrong_count(spark):
    items = spark.createDataFrame([(i, "t", 1, 0, 0, 0) for i in range(4)], "i int, text string, c int, stretch int, length_bucket int, batch_no int")
    rows = work.score_batches(items, lambda texts: [1.0], ["c", *work.BATCH_KEY], "i").collect()
    assert sorted(r.score for r in rows) == [1.0] * 4 and all(r.call_size == 1 for r in rows)


def test_only_failing_items_are_tried_again(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "id int")
    sizes = []

    def step(pending, attempt):
        sizes.append(pending.count())
        return pending.select("id", (F.col("id") <= attempt).alias("passed"))

    done = {r.id: (r.attempts, r.status) for r in work.retry_loop(items, step, "id", max_retry=3).collect()}
    assert done == {0: (1, "completed"), 1: (2, "completed"), 2: (3, "completed"), 3: (4, "completed"), 4: (4, "exhausted"), 5: (4, "exhausted")}
    assert sizes == [6, 5, 4, 3]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds far more than a third of the rows."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 20), i, rng.randint(0, 5)) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "k int, at int, v int")


def test_running_totals_with_a_hot_key(spark, skewed):
    rows, df = skewed
    found = {r.at: (r.n, r.total) for r in scan.running(df, ["k"], ["at"], {"n": F.lit(1), "total": F.col("v")}, parts=20).collect()}
    state = {}
    for k, at, v in rows:
        n, total = state.get(k, (0, 0))
        state[k] = (n + 1, total + v)
        assert found[at] == state[k]


def test_global_positions(spark, skewed):
    rows, df = skewed
    found = {r.at: r.p for r in scan.position(df, [], ["v", "at"], "p", parts=20).collect()}
    expected = sorted(rows, key=lambda r: (r[2], r[1]))
    assert all(found[r[1]] == i for i, r in enumerate(expected, 1))


def test_null_keys_stay_in_the_spread_path(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [(1, i) for i in range(3)], "k int, at int")
    rows = scan.position(df, ["k"], ["at"], "p", parts=30).collect()
    assert len(rows) == 53 and sorted(r.p for r in rows if r.k is None) == list(range(1, 51))


def test_longest_runs_with_a_hot_key(spark, skewed):
    rows, df = skewed
    found = {r.k: r.n for r in scan.longest_runs(df, ["k"], ["at"], F.col("v") < 4, parts=20).groupBy("k").agg(F.max("run_length").alias("n")).collect()}
    best, run = {}, {}
    for k, _, v in rows:
        run[k] = run.get(k, 0) + 1 if v < 4 else 0
        best[k] = max(best.get(k, 0), run[k])
    assert found == {k: n for k, n in best.items() if n}


def test_markers_round_half_to_even(spark):
    df = spark.createDataFrame([(1, 1, 0.0005), (1, 2, 0.001), (1, 3, 0.001)], "b int, i int, duration double")
    rows = order.chapter_markers(df, ["b"], ["i"]).orderBy("i").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, 0), (0, 2), (2, 2)]


def test_budget_stream_equals_batch_over_several_triggers(spark, tmp_path):
    rng = random.Random(5)
    fields = "id long, seq long, kind string, policy string"
    rows = [(rng.randint(0, 6), i, "failed" if rng.random() < 0.8 else "completed", "p" if i < 150 else "q") for i in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    batch = spark.createDataFrame(rows, fields)
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    store = st.budget_store(spark, str(tmp_path / "budgets"), buckets=3)
    found = {tuple(r) for r in st.retry_budget(stream, store, str(tmp_path / "spent"), str(tmp_path / "marks")).collect()}
    expected = {tuple(r) for r in st.retry_budget_batch(batch).collect()}
    spread = {tuple(r) for r in st.retry_budget_batch(batch, parts=20).collect()}
    assert found == expected == spread and expected


def test_summaries_keep_what_has_not_started(spark):
    from lectern.operators import rollup
    from lectern.sources import writers
    state = spark.createDataFrame([("a", 1, "completed", True, 0.1, 1, 2.0, 1.0, 5), ("z", 9, "failed", False, None, None, 1.0, 1.0, 5)],
                                  "book string, segment_id int, status string, qc_pass boolean, cer double, retry_count int, duration double, generation_seconds double, chars int")
    plan = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "book string, segment_id int")
    found = {r.book: (r.total, r.completed, r.failed, r.retries, r.percent) for r in rollup.state_summary(state, plan, "book").collect()}
    assert found == {"a": (2, 1, 0, 1, 50.0), "b": (1, 0, 0, 0, 0.0), "z": (0, 0, 1, 0, 0.0)}
    exports = spark.createDataFrame([("a", "s1", "x"), ("b", "s2", "y")], "book_id string, signature string, path string")
    runs = spark.createDataFrame([("a", "s1", 1)], "book_id string, signature string, run_at int")
    assert {(r.book_id, r.current, r.location) for r in writers.supersede(exports, runs).collect()} == {("a", True, "x"), ("b", False, "previous/s2/y")}


def test_damaged_utf16_is_an_error_row(spark):
    from lectern.sources import readers
    rows = [("good", "h\u00e9".encode("utf-16")), ("odd", b"\xff\xfeA"), ("lone", b"\xff\xfe\x00\xd8"), ("utf8", "h\u00e9".encode()), ("gb", "\u4f60\u597d".encode("gb18030"))]
    good, bad = readers.decode_text(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path: r.text for r in good.collect()} == {"good": "h\u00e9", "utf8": "h\u00e9", "gb": "\u4f60\u597d"}
    assert {r.path for r in bad.collect()} == {"odd", "lone"}


def test_streams_read_folders_of_part_files(spark, tmp_path):
    from lectern.streaming import jobs
    spark.range(30).repartition(5).write.parquet(f"{tmp_path}/numbers.parquet")
    spark.range(100).write.parquet(f"{tmp_path}/numbers_other.parquet")
    out = jobs.drain(jobs.read_table(spark, str(tmp_path), "numbers"))
    assert out.count() == 30
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        jobs.read_table(spark, str(tmp_path), "missing")


def test_log_lines_keep_their_order_over_splits(spark, tmp_path):
    from lectern.sources import readers
    (tmp_path / "a.log").write_text("\n".join(f"line {i} é" for i in range(5000)) + "\n")
    (tmp_path / "b.log").write_text("only\n\nthree")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for r in rows:
        by.setdefault(r.file[-5:], {})[r.line_no] = (r.line, r.bytes)
    assert by["a.log"] == {i + 1: (f"line {i} é", len(f"line {i} é".encode()) + 1) for i in range(5000)}
    assert by["b.log"] == {1: ("only", 5), 2: ("", 1), 3: ("three", 6)}


def test_clips_without_a_signal_are_errors(spark, tmp_path):
    from lectern.sources import readers
    rows = [(1, 8, 1, [0.5]), (2, None, 1, [0.5]), (3, 8, 2, [0.5]), (4, 8, 1, None)]
    spark.createDataFrame(rows, readers.CLIPS).write.parquet(f"{tmp_path}/clips")
    assert {r.clip_id: r.error for r in readers.read_clips(spark, f"{tmp_path}/clips").collect()} == {1: None, 2: "no rate or channels", 3: "incomplete frame", 4: "no samples"}


def test_books_from_files_to_chapters(spark):
    from lectern.sources import books
    def packed(parts):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as box:
            for name, value in parts.items():
                box.writestr(name, value)
        return buffer.getvalue()
    container = "<container><rootfiles><rootfile full-path='OPS/p.opf'/></rootfiles></container>"
    package = ("<package><metadata><title>Tale</title><creator>Someone</creator></metadata><manifest><item id='n' href='text/toc.xhtml' media-type='application/xhtml+xml' properties='nav'/>"
               "<item id='a' href='text/a.xhtml' media-type='application/xhtml+xml'/></manifest><spine><itemref idref='n'/><itemref idref='a'/></spine></package>")
    nav = "<html xmlns:epub='e'><body><nav epub:type='landmarks'><a href='x'>no</a></nav><nav epub:type='toc'><ol><li><a href='a.xhtml'>The <b>first</b></a></li></ol></nav></body></html>"
    tale = packed({"META-INF/container.xml": container, "OPS/p.opf": package, "OPS/text/toc.xhtml": nav, "OPS/text/a.xhtml": "<html><body><p>Once upon a time.</p></body></html>"})
    rows = [("in/One.txt", "Chapter 1\nHello there.\nChapter 2\nNotes only.\nChapter 3\nThe end.".encode()), ("in/empty.txt", b" \n"), ("in/odd.txt", b"\xff\xfeA"),
            ("in/tale.epub", tale), ("in/bad.epub", b"x"), ("in/skip.md", b"no")]
    found = books.parse_books(spark.createDataFrame(rows, "path string, content binary"), exclude=["Chapter 2"])
    assert {(r.book_id, r.title, r.author) for r in found["books"].collect()} == {("in/One.txt", "One", ""), ("in/empty.txt", "empty", ""), ("in/tale.epub", "Tale", "Someone")}
    assert sorted((r.book_id, r.chapter_index, r.title) for r in found["chapters"].collect()) == [("in/One.txt", 1, "Chapter 1"), ("in/One.txt", 2, "Chapter 3"), ("in/tale.epub", 1, "The first")]
    assert {r.book_id for r in found["errors"].collect()} == {"in/empty.txt", "in/odd.txt", "in/bad.epub"}
    assert ("in/One.txt", "user_excluded_chapter") in {(r.book_id, r.operation) for r in found["audit"].collect()}


def test_batches_of_texts_are_bounded(spark, tmp_path):
    from lectern.plans.inputs import documents
    path = str(tmp_path)
    spark.range(3000, numPartitions=1).selectExpr("id doc_id", "'en' lang", "'s' source", "repeat('word ', 400) text").write.parquet(f"{path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
    seen = [r["n"] for r in documents(spark, path).coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(seen) == 3000 and max(seen) <= 500


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    from lectern.sources import store
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    rows = spark.range(200_000, numPartitions=8).selectExpr("id", "uuid() v")
    table = store.KeyedStore(spark, str(tmp_path / "t"), rows.schema, ("id",), store.newest(["id"], ["v"]), buckets=2)
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        assert table.merge(rows, 0) and table.merge(rows, 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert table.read().count() == table.read().select("id").distinct().count() == 200_000
    assert all(len(list(p.glob("*.parquet"))) > 1 for p in (tmp_path / "t" / "data").glob("slot=*/bucket=*"))


def test_confined_paths_agree_with_their_steps(spark):
    from lectern.operators import select as sel
    paths = ["a/b.mp3", "/o/1/a.mp3", "/o/10/a.mp3", "/o/1", "/o/1/", "", "/", "a", "./a", "../a", "a/../b", "a//b", "/o//1/a", "/o/1/../2/a", "/o/1/./a", "a/", "..", ".", "a/..", ".a/b", "..a", "a..b/c.", "/o/1/..a", None]
    folders = ["/o/1", "/o/1/", "/..", "/", "o/1", "", "/o/./1", None]
    rows = spark.createDataFrame([(p, f) for p in paths for f in folders], "path string, folder string")
    both = rows.select("path", "folder", sel.confined(F.col("path"), F.col("folder")).alias("fast"), sel._confined_steps(F.col("path"), F.col("folder")).alias("steps"))
    assert both.filter("NOT (fast <=> steps)").collect() == []


def test_containers_are_packed_and_opened_once(spark):
    """All uses of the files read what was written: no plan packs or opens containers again."""
    from lectern.plans import job_queries
    rows = job_queries.parse_books(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" not in plan and rows.count() == 251


def test_batches_of_a_run_are_planned_without_texts(spark, monkeypatch):
    from lectern.plans import lifecycle_queries as life
    seen, plan = [], life.work.plan_batches
    monkeypatch.setattr(life.work, "plan_batches", lambda items, *rest: seen.append(items.columns) or plan(items, *rest))
    fates = life.outcomes(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any("text" in columns for columns in seen)
    assert fates.groupBy("source", "segment_id").count().filter("count > 1").isEmpty() and fates.filter("length(segment_id) <> 64 OR fate IS NULL").isEmpty()


def test_previews_are_ranked_by_keys_alone(spark):
    """A book with most of the records, in many partitions: its records' previews stay out of the ranks and of the shuffle before them."""
    from lectern.operators import clean as cl
    rows = spark.range(0, 5000, 1, 40).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("book"), (4999 - F.col("id")).alias("at"), F.array(F.repeat(F.lit("x"), 600)).alias("removed"))
    shown = cl.audit_preview(rows, "book", ["at"])
    assert "Window" not in shown._jdf.queryExecution().analyzed().toString()
    found = shown.select("book", "at", "position", "audit_count", "audit_truncated", F.length(F.get("removed", F.lit(0))).alias("n")).collect()
    assert {(r.book, r.audit_count, r.audit_truncated, r.n) for r in found} == {("small", 100, False, 500), ("large", 4900, True, 500)}
    large = sorted((r.position, r["at"]) for r in found if r.book == "large")
    assert large == list(enumerate([at for at in range(5000) if (4999 - at) % 50][:100], 1)) and set(shown.columns) == {"book", "at", "removed", "position", "audit_count", "audit_truncated"}


def test_a_table_of_some_splits_gets_more_parts_than_cores(spark):
    from lectern.plans import inputs
    cores = spark.sparkContext.defaultParallelism
    parts = [inputs.balanced(spark.range(0, 100, 1, n), "id").rdd.getNumPartitions() for n in (1, cores, cores + 1)]
    assert parts == [max(cores, 4), 4 * cores, cores + 1]


# ---- texts as files and tables hold them -------------------------------------------------------------------------

ODD_TEXTS = ["", None, "\n", "\n\n\n", "  ", "One.\nTwo.\n", "One.\n\n", "\n\nOne.", "Same\nSame\nbody", "  Same \nSame\n Same\nbody", "A\nA\nA", "a\r\na\r\nb\r\n", "a\rb", "a\u2028a\u2028b",
             "Title:\nTitle:Title:\nx", "\ufeffmarked", "\ufeff\ufeffmarked", "\ufeff", "!!! ...", "\x00a\x00", "\u4f60\U0001f600", "plain words"]


def odd_documents(spark, folder):
    """Every odd text under twelve ids, which also are every remainder of 3 and 4, some of them negative."""
    rows = [(12 * i + k - 60, "en", "s", text) for i, text in enumerate(ODD_TEXTS) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return {row[0]: row[3] for row in rows}


def test_title_lines_go_and_nothing_else(spark):
    from lectern.operators import chapters as ch
    cases = [("T\nT\nbody\n", "T\nbody\n"), ("T\nbody\n\n", "T\nbody\n\n"), ("T\r\n T\r\nT\r\nx\r\ny", "T\r\nx\r\ny"), ("T\rT\nx\x85y\r\n", "T\nx\x85y\r\n"), ("T\n\nT\n", "T\n\nT\n"),
             ("T\u2028T\u2028x", "T\u2028x"), ("T\nT\nT", "T"), ("T\nT\n", "T\n"), ("x\nT\nT", "x\nT\nT"), ("", ""), ("\n", "\n"), (None, None)]
    rows = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "id int, text string")
    found = {r.id: r.t for r in rows.select("id", ch.drop_duplicate_title_lines(F.col("text"), F.lit("T")).alias("t")).collect()}
    assert found == {i: c[1] for i, c in enumerate(cases)}


def test_texts_keep_all_but_the_repeated_title(spark, tmp_path):
    from lectern.plans.chapter_queries import c7_drop_duplicate_title_lines
    texts = odd_documents(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in c7_drop_duplicate_title_lines(spark, str(tmp_path)).collect()} == texts


def test_books_without_text_are_listed(spark, tmp_path):
    from lectern.plans.job_queries import parse_books
    texts = odd_documents(spark, str(tmp_path))
    markup = ["<p>Text.</p>", "", None, "<p>!!!</p>", "<script>a</script>", "<h1>Head</h1>\n<p>Text.</p>"]
    spark.createDataFrame(list(enumerate(markup)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, parse_books(spark, str(tmp_path)).collect()), key=str)
    want = [(f"{i}.txt", str(i), "", 1) for i in texts] + [(f"{i}.epub", f"Page {i}", "Author", 1) for i in range(len(markup))] + [("broken.epub", None, None, None)]
    assert found == sorted(want, key=str)


def test_texts_come_back_from_marked_and_empty_files(spark, tmp_path):
    from lectern.plans.job_queries import src2_decode_text
    texts = odd_documents(spark, str(tmp_path))
    found = {r.doc_id: (r.text, r.encoding) for r in src2_decode_text(spark, str(tmp_path)).collect()}
    assert found == {i: (text, "utf-16" if i > 0 and i % 3 == 1 else "utf-8") for i, text in texts.items()}
