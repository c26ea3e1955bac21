"""Name and place search on invented company names, and against brute force."""

from decimal import Decimal

import pytest
from helpers import make, only, rows
from pyspark.sql import functions as F

from bookwise import constants as K
from bookwise.functions.contains import matching_literal, matching_wildcards, pattern, piece_index
from bookwise.functions.names import first_word, phonetic_key, trigrams
from bookwise.operators import customer, search, views

NAMES = [
    "BUIST INCORPORATED", "ALT MECHANICAL", "D&D MECHANICAL", "NORTH SHORE PIPE", "HARBOR VALVE & FITTING", "KNIGHT PLUMBING",
    "SMITH BROTHERS", "SCHMIDT HEATING", "OAK_RIDGE 70% SUPPLY", "OAKWRIDGE SUPPLY", "THOMPSON UTILITY", "CHURCH ST BUILDERS",
    "XAVIER STEEL", "PHILIPS PUMPS", "GREEN VALLEY WATER", "GREENE VALLEY FARMS", "LAKE SUPPLY", "LAKESIDE SUPPLY CO", "O'BRIEN TANKS",
    "A1 PIPE", "AB", "MCHUGH WELDING", "ROUGH CUT LUMBER", "DELTA PROCESS", "DELTA PROCESS EAST", "ÉCLAIR FOODS", "TRI-COUNTY GAS",
    "BACK\\SLASH LLC", "Mixed Case Piping", "WRIGHT TOOL",
]


@pytest.fixture(scope="module")
def dim(spark):
    rows_ = [
        {"customer_id": str(100 + i), "customer_name": n, "phys_city": "MONROE" if i % 2 else "SALEM", "phys_state": "NJ", "phys_zip": f"088{i:02d}-1"}
        for i, n in enumerate(NAMES)
    ]
    return views.customer_all(make(spark, "customers", rows_), make(spark, "salesreps", []))


@pytest.fixture(scope="module")
def figures(spark):
    return spark.createDataFrame(
        [(str(100 + i), Decimal(1000 * i), None) for i in range(0, len(NAMES), 3)], "customer_id string, year_sales decimal(28,2), last_invoice date"
    )


def ask(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def test_misheard_name_is_found_by_sound(spark, dim, figures):
    found = search.search_customer(dim, figures, ask(spark, "Boost")).collect()
    assert "BUIST INCORPORATED" in {r["customer_name"] for r in found} and all(r["note"] == K.FUZZY_NOTE for r in found)


def test_nonsense_and_short_queries_find_nothing(spark, dim, figures):
    assert search.search_customer(dim, figures, ask(spark, "zzqxvwq", "qz")).isEmpty()


def test_a_non_customer_gets_flagged_candidates(spark, dim, figures):
    found = search.search_customer(dim, figures, ask(spark, "Acme Mechanical")).collect()
    assert {"ALT MECHANICAL", "D&D MECHANICAL"} <= {r["customer_name"] for r in found}
    assert all(r["note"] and r["name_similarity"] < 0.8 for r in found)


def test_lookup_by_id(spark, dim, figures):
    found = only(search.search_customer(dim, figures, ask(spark, " 100 ")))
    assert found["customer_name"] == "BUIST INCORPORATED" and found["note"] is None and found["sales_12m"] == 0


QUERIES = ["pipe", "DELTA", "oak_ridge", "70%", "a", "ab", "", "%", "_", "____________________", "k%supply", "'", "valley", "Mixed Case Piping and more", "é", "t b", "back\\\\slash", "sl\\ash", "E", "%a%", "_&_", "104"]


def test_contained_queries_equal_a_pattern_scan(spark, dim):
    index = piece_index(dim, "customer_name")
    asked = search._asked(ask(spark, *QUERIES))
    ours = set(rows(matching_literal(index, asked).unionByName(matching_wildcards(index, asked)).distinct()))
    theirs = index.texts.crossJoin(asked.withColumn("p", pattern())).where(F.expr("text ILIKE p")).select("query", "text")
    assert ours == set(rows(theirs)) and len(ours) > 60


def test_exact_path_equals_a_pattern_scan(spark, dim, figures):
    asked = search._asked(ask(spark, *QUERIES))
    ours = set(rows(search.find_customer(dim, figures, asked).select("query", "customer_id")))
    names = customer.with_figures(dim, figures).crossJoin(asked.withColumn("p", pattern())).where(F.expr("customer_name ILIKE p OR customer_id = query"))
    found = {}
    for r in names.collect():
        found.setdefault(r["query"], []).append((-r["sales_12m"], r["customer_name"].encode(), r["customer_id"]))
    theirs = {(q, x[2]) for q, v in found.items() for x in sorted(v)[: K.EXACT_ROWS]}
    assert ours == theirs and {q for q, _ in ours} >= {"", "%", "_", "a", "104"} and len(ours) > 60


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_search_is_a_product(spark, dim, figures):
    places = spark.createDataFrame([("S%M", None), ("%", "100"), ("nj", None)], "place string, exclude_customer_id string")
    plans = [
        plan_of(search.find_customer(dim, figures, ask(spark, *QUERIES))), plan_of(search.fuzzy_customer(dim, figures, ask(spark, "suply", "Boost"))),
        plan_of(customer.customers_near(dim, figures, places, 5)),
    ]
    assert not [p for p in plans if "CartesianProduct" in p or "NestedLoop" in p]


def test_common_sounds_are_spread(spark, monkeypatch):
    names = spark.createDataFrame([(str(i), "Boost" if i % 2 else "") for i in range(60)] + [("x", None)], "customer_id string, customer_name string")
    monkeypatch.setattr(search, "SOUND_BLOCK", 7)
    found = search._sounding_alike(names, spark.createDataFrame([("buist here",), ("",), ("zzz",)], "query string"))
    ours = {(r[0], r[1]) for r in found.collect()}
    assert ours == {("buist here", str(i)) for i in range(1, 60, 2)} | {("", str(i)) for i in range(0, 60, 2)}
    assert "hashpartitioning(sound" in plan_of(found) and "block" in plan_of(found)


def test_trigram_arm_equals_brute_force(spark, dim):
    queries = ["Buist Inc", "lake suply", "greenvalley", "mech", "oak ridge", "delta proces est", "pip", "north"]
    asked = ask(spark, *queries).withColumn("query_trigrams", trigrams("query"))
    named = dim.withColumn("name_trigrams", trigrams("customer_name"))
    ours = set(rows(search._trigram_matches(named, asked)))

    def grams(text):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    theirs = {
        (q, str(100 + i)) for q in queries for i, n in enumerate(NAMES) if len(grams(q) & grams(n)) / len(grams(q) | grams(n)) > 0.2
    }
    assert ours == theirs and theirs


def test_similarity_of_exactly_one_fifth_counts(spark, dim):
    # single precision 0.2 is a little above 0.2: one shared trigram of five in all
    asked = ask(spark, "ab").withColumn("query_trigrams", trigrams("query"))
    named = spark.createDataFrame([("1", "ax")], "customer_id string, customer_name string").withColumn("name_trigrams", trigrams("customer_name"))
    assert rows(search._trigram_matches(named, asked)) == [("ab", "1")]


@pytest.mark.parametrize("word,code", [
    ("Boost", "PST"), ("Buist", "PST"), ("Smith", "SM0"), ("Schmidt", "XMT"), ("Thompson", "TMPS"), ("Knight", "NT"), ("Wright", "RT"),
    ("Michael", "MKL"), ("Church", "XRX"), ("Caesar", "SSR"), ("Jose", "HS"), ("Xavier", "SF"), ("Philip", "FLP"), ("Laugh", "LF"),
    ("Science", "SNS"), ("School", "SKL"), ("Schwartz", "XRTS"), ("Hugh", "H"), ("Broughton", "PRTN"), ("Accident", "AKST"),
    ("Bacci", "PX"), ("Ghost", "KST"), ("Edge", "AJ"), ("Edgar", "ATKR"), ("Plumber", "PLMR"), ("Campbell", "KMPL"), ("Isle", "AL"),
    ("Sugar", "XKR"), ("Nation", "NXN"), ("Thomas", "TMS"), ("Filipowicz", "FLPT"), ("Breaux", "PR"), ("Whirl", "ARL"), ("McHugh", "MK"),
    ("Danger", "TNJR"), ("Rogier", "RJ"), ("Cagney", "KKN"), ("Orchestra", "ARKS"), ("Reach", "RK"), ("D&D", "TT"), ("", ""), (None, None),
])
def test_phonetic_key(spark, word, code):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(phonetic_key(first_word("w"))).first()[0] == code


def test_near_by_town_zip_state_and_nowhere(spark, dim, figures):
    asked = spark.createDataFrame(
        [("monroe", "101"), ("08805", None), ("nj", None), ("Nowheresville", None), ("S%M", None)], "place string, exclude_customer_id string"
    )
    found = customer.customers_near(dim, figures, asked, 5).collect()
    by = {p: [r for r in found if r["place"] == p] for p in ("monroe", "08805", "nj", "Nowheresville", "S%M")}
    assert by["monroe"] and all(r["customer_id"] != "101" and r["city"] == "MONROE" for r in by["monroe"])
    assert len(by["nj"]) == 5 and not by["Nowheresville"] and all(r["city"] == "SALEM" for r in by["S%M"])
    everything = customer.customers_near(dim, figures, asked, 500).where("place = '08805'").collect()
    assert {r["how"] for r in everything} == {"same zip", "nearby zip"} and len(everything) == len(NAMES)


def test_two_arms_of_search_are_ranked_and_cut(spark, dim, figures):
    found = search.fuzzy_customer(dim, figures, ask(spark, "suply"))
    ranked = [r["name_similarity"] for r in found.collect()]
    assert 0 < len(ranked) <= K.FUZZY_ROWS


def test_vocabulary_is_clean_and_ordered(spark, dim):
    pg12 = spark.createDataFrame([("102", Decimal(5)), ("101", Decimal(9))], "customer_id string, sales_12m decimal(18,2)")
    pen = spark.createDataFrame([("P/VC", 6.0), ("Rare", 4.9)], "product_group_desc string, penetration_pct double")
    assert rows(customer.vocabulary(dim, pg12, pen)) == [("customers", "ALT MECHANICAL, D&D MECHANICAL"), ("products", "P VC")]
