"""Values that one owner copies into many repositories are examples."""

from carespend.llm.secret_scan import EXAMPLE_REPOS, ownership, scan

MIXED, ASSIGNED = "Sample0Sample0Sample0Sample1", "sample-0123456789"


def rows(n, owner="hot"):
    return [(k, f"key {MIXED} and password={ASSIGNED}", owner) for k in range(n)]


def verdicts(spark, docs):
    got = scan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    return {(r["n_assign"], r["n_owned"], r["n_live"], r["n_example"]) for r in got}


def test_one_owner_in_few_and_in_many_repositories(spark):
    assert verdicts(spark, rows(EXAMPLE_REPOS - 1)) == {(1, 1, 2, 0)}
    assert verdicts(spark, rows(EXAMPLE_REPOS)) == {(1, 0, 0, 1)}
    assert verdicts(spark, rows(EXAMPLE_REPOS, None)) == {(1, 0, 0, 1)}


def test_copies_in_one_repository_are_one(spark):
    assert verdicts(spark, rows(1) * 50) == {(1, 1, 2, 0)}


def test_a_repository_of_two_owners_counts_once(spark):
    found = spark.createDataFrame(
        [(repo, owner, [(0, 0, 1, 7)], []) for repo in (1, None) for owner in ("a", "b", None)],
        "repo long, owner string, base array<struct<start:int,kind:int,end:int,value:bigint>>, more array<struct<start:int,kind:int,end:int,value:bigint>>",
    )
    assert [tuple(r) for r in ownership(found).collect()] == [(7, 2, 3)]
