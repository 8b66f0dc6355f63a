from pyspark.sql import functions as F

from questloom.operators import documents as O
from questloom.operators import patterns as A
from questloom.operators import thresholds as T
from questloom.rules import documents as D


def test_linked_total_uses_the_entity_type(spark):
    events = spark.createDataFrame([("e1", "Party", "Meeting")], "event string, name string, type string")
    budgets = spark.createDataFrame([("b1", "e1"), ("b2", "e1")], "budget string, event string")
    costs = spark.createDataFrame(
        [("b1", "122.06", "true"), ("b1", "1,000", "false"), ("b2", "53.33", "Approved"), ("b9", "7", "true")],
        "budget string, cost string, approved string",
    )
    row = A.linked_total(events, budgets, costs, "event", "budget", "type", "name", "cost", "approved").first()
    assert (row.type, row.total_value) == ("Meeting", "175.39")


def test_literal_rank_is_not_the_position(spark):
    df = spark.createDataFrame([(1, "3", "2", "+16.445"), (1, "2", "4", "+1.0")], "race int, position string, rank string, time string")
    assert [r.time for r in A.rank_attached(df, "rank", 2).collect()] == ["+16.445"]


def test_unit_price_values_once_in_first_seen_order(spark):
    tx = spark.createDataFrame(
        [(1, 10, 60.0, 2.0), (2, 11, 90.0, 3.0), (3, 10, 80.0, 2.0), (4, 12, 5.0, 0.0), (5, 13, 10.0, 2.0)],
        "tx int, cust int, price double, amount double",
    )
    ym = spark.createDataFrame([(10, 222.2), (11, 333.3), (12, 1.0), (13, 2.0)], "c int, consumption double")
    got = A.unit_ratio_first_seen(tx, ym, F.col("cust") == F.col("c"), "price", "amount", 29.0, "consumption", "tx")
    assert [r.consumption for r in got.collect()] == [222.2, 333.3]


def test_average_keeps_negative_values(spark):
    hero = spark.createDataFrame([(1, 2, 50.0), (2, 2, -99.0), (3, 1, 80.0)], "id int, g int, w double")
    kind = spark.createDataFrame([(1, "Male"), (2, "Female")], "gid int, gender string")
    got = A.filtered_join_average(hero, kind, F.col("g") == F.col("gid"), "gender", "female", "w").first()
    assert got.average == -24.5


def test_entity_count_counts_the_filtered_items(spark):
    atoms = spark.createDataFrame([("a1", "m1"), ("a2", "m1"), ("a3", "m2")], "atom string, mol string")
    bonds = spark.createDataFrame([("m1",), ("m1",)], "molecule string")
    assert A.count_related_entities(atoms, bonds, "mol", "molecule", ["atom"]).first().entity_count == 2


def test_same_row_and_entity_level_counts_differ(spark):
    rows = spark.createDataFrame(
        [(1, "p", 5.0, None), (2, "p", 99.0, 1.0), (3, "q", 5.0, 1.0), (4, "r", 6.0, None)],
        "row int, entity_id string, m1 double, m2 double",
    )
    normal = T.normal_candidates(T.numeric_profile(rows.filter("m1 < 50"), [], "m1"))
    abnormal = T.abnormal_candidates(T.normal_candidates(T.numeric_profile(rows, [], "m2")))
    src = spark.createDataFrame([("s", "s", "p"), ("s", "s", "q"), ("s", "s", "x")], "source_type string, source string, entity_id string")
    grid = T.probe_grid(rows, "entity_id", "m1", "m2", normal, abnormal, src)
    row = grid.filter("normal_name = 'all_observed_non_null' AND mode = 'non_null'").first()
    assert (row.same_row_count, row.entity_count) == (1, 2)


def test_evidence_prefers_the_corrected_value(spark):
    text = (
        "Operative file 7 has a height recorded as 170.\n\n"
        "For operative 7 the height was corrected to 181.\n\n"
        "The hero registered under identifier 7 has publisher affiliation 13."
    )
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    v = O.field_values(df, "doc_id", "text", {f: (f, *D.FIELD_ALIASES[f]) for f in ("height", "publisher affiliation")}, "operative")
    row = O.evidence_table(v, "doc_id", ["height", "publisher affiliation"]).first()
    assert (row.entity_id, row.height, row["publisher affiliation"]) == ("7", 181.0, 13.0)
    assert row.height_evidence.confidence == 98


def test_narratives_give_back_what_was_written(spark):
    """What the text generator wrote about each client is what extraction reads."""
    from questloom.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    got = O.records(t.narratives, "doc_id", "text", ["balance"], "client").filter("paragraph_index = 1")
    # A balance that looks like a year comes first in the sentence and is taken for one.
    like_year = F.floor("c_acctbal").between(1800, 2099)
    year = F.when(like_year, F.floor("c_acctbal")).otherwise(F.col("c_custkey") % 50 + 1950)
    want = t.customer.select("c_custkey", F.round("c_acctbal", 2).alias("b"), year.alias("y"))
    both = got.join(want, F.col("doc_id") == F.col("c_custkey"))
    bad = both.filter("NOT (entity_id = string(c_custkey) AND number <=> b AND year <=> y)")
    assert both.count() == t.customer.count() and bad.count() == 0
