"""Every query of the corpus jobs against its SQL, and column rules on hand-made rows."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import defects, layout, markers
from quire.operators import agents, evidence, progress, units
from quire.operators import layout as places
from quire.plans import QUERIES, SQL
from quire.sources import ingest, views

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert got == expected and (got or os.environ.get("TEST_SF_DIR"))


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_marker_pairs(spark):
    rows = [
        ("a {v1} b", "x {v1} y", "x {v1} y"), ("a {v1} b", "x ( v1 ) y", "x {v1} y"), ("a {v1} b", "x （v1） y", "x {v1} y"), ("a {v1} b", "x y", None), ("a {v1} b", "x {v1} {v1}", None),
        ("a b", "x {v7} y", "x y"), ("<b>a</b>", "&lt;b&gt;x&lt;/b&gt;", "<b>x</b>"), ("<b>a</b>", "<b>x", "x"), ("a", "<i>x</i>", "x"), ("a", "  ", None), ("a", None, None), ("{v2} {v10}", "{v10}  {v2}", "{v10} {v2}"),
    ]
    assert [r[0] for r in values(spark, [(a, b) for a, b, _ in rows], "en string, vi string", markers.check("en", "vi"))] == [c for *_, c in rows]


def test_equal_rectangles_are_each_shaved(spark):
    rectangles = spark.createDataFrame([("t", 1, 7, 0.0, 0.0, 10.0, 20.0)] * 2 + [("t", 2, 7, 0.0, 0.0, 10.0, 20.0)], "tag string, page int, id int, x0 double, y0 double, x1 double, y1 double")
    kept = spark.createDataFrame([("t", 1, 0, 0.0, 18.0, 10.0, 30.0)], "tag string, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page, r.y0, r.y1) for r in evidence.shave_redacts(rectangles, kept).collect())
    assert got == [(1, 0.0, 17.0), (1, 0.0, 17.0), (2, 0.0, 20.0)]


def test_number_cells_and_formulas(spark):
    cells = {"1,234.5": True, "EUR0": True, "−USD1,800": True, "(12%)": True, "ABCDE12": False, "year 2020": False, "--": False, "": False}
    assert values(spark, [(c,) for c in cells], "t string", layout.num_cell(F.col("t"))) == [(v,) for v in cells.values()]
    lines = {"V0 = (1 + r)^2": True, "σ² = ∑ (x − µ)²": True, "The value of the portfolio rises to 12.": False, "= 0.6 × 3": True, "": False}
    assert values(spark, [(c,) for c in lines], "t string", layout.formula_like(F.col("t"))) == [(v,) for v in lines.values()]


def test_defect_rules_take_the_first(spark):
    rows = {"Tràn Khung": ("tran_khung", "text"), "ĐÈ lên bảng": ("bang_vo", "code"), "mất HIGHLIGHT ở bảng": ("highlight_mat", "policy"), "": ("khac", "unknown"), None: ("khac", "unknown")}
    assert values(spark, [(c,) for c in rows], "d string", defects.classify(F.col("d"), 0), defects.classify(F.col("d"), 1)) == list(rows.values())


def test_nested_errors(spark):
    rows = {'{"error":{"message":"{\\"message\\":\\" deep \\"}"}}': "deep", "plain": "plain", '{"message":"  "}': '{"message":"  "}', "{bad": "{bad"}
    assert values(spark, [(c,) for c in rows], "e string", agents.unwrap_error(F.col("e"))) == [(v,) for v in rows.values()]


def test_checkpoints_that_cannot_be_read_are_queued_again(spark):
    rows = [("a", "0", '{"t0":"x"}'), ("a", "1", '{"t0":'), ("a", "2", "[]"), ("a", "3", " {} "), ("a", "4", "")]
    shapes = units.read_checkpoints(spark.createDataFrame(rows, "tag string, idx string, raw string"))
    assert [r["shape"] for r in shapes.orderBy("idx").collect()] == ["object", "bad", "list", "object", "bad"]


def test_chunk_names_grow(spark):
    assert values(spark, [(0,), (999,), (1000,)], "n int", units.chunk_name(F.col("n"))) == [("000",), ("999",), ("1000",)]


def test_stage_gates(spark):
    done = lambda rows: spark.createDataFrame(rows, "tag string, done boolean")
    status = progress.stage_status(
        done([("a", True), ("b", True), ("b", False), ("c", True), ("d", True)]), done([("a", True), ("b", True), ("c", False), ("d", True)]), done([("a", True), ("b", True), ("c", True), ("d", True)]),
        spark.createDataFrame([("d",)], "tag string"),
    )
    assert {r.tag: (r.stage, r.v_done, r.p_done) for r in status.collect()} == {"a": ("done", 1, 1), "b": ("translate", 0, 0), "c": ("verify", 0, 1), "d": ("review", 1, 1)}
    assert {r.tag: r.pct for r in progress.overall_pct(status).collect()} == {"a": 100, "b": 20, "c": 40, "d": 95}


def test_page_lists(spark):
    rows = spark.createDataFrame([(1, "5-3, 9,x, 0-1"), (2, ""), (3, "99")], "k int, spec string")
    assert sorted(map(tuple, ingest.page_list(rows, "spec", F.lit(9)).select("k", "page").collect())) == [(1, 1), (1, 3), (1, 4), (1, 5), (1, 9)]


def test_written_volumes_replace_only_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    ingest.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "tag string, n int"), path)
    ingest.write_table(spark.createDataFrame([("b", 3)], "tag string, n int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("tag", "n").collect())) == [("a", 1), ("b", 3)]


def test_volumes_share_folders(spark, tmp_path):
    """Many volumes are few folders; a volume beside others of its folder is replaced alone, one without a name too."""
    path = f"file://{tmp_path}/memory"
    tag = F.when(F.col("id") > 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("tag")
    ingest.write_table(spark.range(1000).select(tag, F.col("id").alias("n")), path)
    assert len([d for d in os.listdir(f"{tmp_path}/memory") if "=" in d]) <= ingest.BUCKETS
    ingest.write_table(spark.range(0, 1000, 50).select(tag, (-F.col("id") - 1).alias("n")), path)
    got = {r.tag: r.n for r in spark.read.parquet(path).collect()}
    assert got == {f"v{i}" if i else None: i if i % 50 else -i - 1 for i in range(1000)} and spark.read.parquet(path).count() == 1000


def test_trusted_items_meet_one_layout(spark):
    """A volume's items are compared with its report where that is whole, else with its saved layout."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    at = (0.0, 0.0, 9.0, 9.0)
    local = spark.createDataFrame([(t, 0, 0, "s0", "text", at) for t in "ab"], f"tag string, page bigint, pos bigint, id string, en string, box {box}")
    report = spark.createDataFrame([("a", 0, 0, "r0", "text", "told", at)], f"tag string, page bigint, pos bigint, id string, source string, translation string, box {box}")
    saved = spark.createDataFrame([(t, 0, 0, "s0", at) for t in "ab"], f"tag string, page bigint, pos bigint, id string, box {box}")
    overrides = spark.createDataFrame([], "tag string, id string, en string, vi string")
    memory = spark.createDataFrame([("b", "text", "known")], "tag string, text string, vi string")
    out = evidence.page_segments(local, local, report, saved, overrides, memory)
    assert sorted((r.tag, r.id, r.vi) for r in out.collect()) == [("a", "r0", "told"), ("b", "s0", "known")]


@pytest.mark.parametrize("name", ["clamp_rules", "annotation_segment", "orphan_bullets", "highlight_match"])
def test_spans_are_derived_once(spark, sf_dir, name):
    """What is compared on a page comes from one table of lines or blocks, not from ``documents`` for each side."""
    assert not [f for f in QUERIES[name](spark, sf_dir).inputFiles() if "documents" in f]


def test_boxes_end_above_what_begins_inside_them(spark):
    """Obstacles on a box's bottom edge or inside the box hold it as well, one after the other in the order of their ids."""
    box = "tag string, page bigint, id bigint, x0 double, y0 double, x1 double, y1 double"
    dims = spark.createDataFrame([("t", p, 612.0, 792.0) for p in range(6)], "tag string, page bigint, width double, height double")
    rows = {
        0: ([(0.0, 10.0, 50.0, 100.0), (0.0, 100.0, 50.0, 150.0)], 98.0),  # on the bottom edge
        1: ([(0.0, 10.0, 50.0, 100.0), (0.0, 60.0, 50.0, 150.0)], 58.0),  # inside
        2: ([(0.0, 10.0, 50.0, 100.0), (0.0, 12.0, 50.0, 150.0), (48.0, 60.0, 90.0, 150.0)], 742.0),  # as high as the box, or beside it but for 2
        3: ([(0.0, 10.0, 50.0, 100.0), (49.0, 100.5, 90.0, 150.0), (0.0, 200.0, 50.0, 250.0)], 198.0),  # half a point below and beside it
        4: ([(0.0, 10.0, 50.0, 100.0), (0.0, 60.0, 50.0, 70.0), (0.0, 59.0, 50.0, 70.0)], 58.0),  # the first leaves the second below
        5: ([(0.0, 10.0, 50.0, 100.0), (0.0, 59.0, 50.0, 70.0), (0.0, 60.0, 50.0, 70.0)], 57.0),
    }
    boxes = spark.createDataFrame([("t", p, i, *b) for p, (found, _) in rows.items() for i, b in enumerate(found)], box)
    got = {r.page: r.limit for r in places.bottom_limit(boxes, boxes, dims).filter("id = 0").collect()}
    assert got == {p: limit for p, (_, limit) in rows.items()}


def scans(df):
    """How often a plan reads ``documents``."""
    return sum("Relation" in line and "doc_id#" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("name", ["same_slot", "label_rows", "shave_redacts", "same_y_stitch"])
def test_documents_are_read_once(spark, sf_dir, name):
    assert scans(QUERIES[name](spark, sf_dir)) <= 1


def test_lines_hold_the_fields_that_are_asked_for(spark, sf_dir):
    assert views.span_lines(spark, sf_dir, *places.BOX).schema["items"].dataType.elementType.names == places.BOX


def test_glossary_lowers_each_text_once(spark, sf_dir):
    """Not once for each term that it meets."""
    joins = [line for line in QUERIES["glossary_relevant"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "ontains(" in line]
    assert joins and not any("lower(" in j for j in joins)


@pytest.mark.parametrize("name", ["bullet_groups", "heading_split_runs"])
def test_lines_with_grid_stay_with_their_page(spark, sf_dir, name):
    """No line is sent to its place on the page to learn whether a table's line stands there, and none carries its kinds."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "kinds" not in plan and not any("Join" in line and "kx" in line for line in plan.splitlines())
