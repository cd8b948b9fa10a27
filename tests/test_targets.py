"""Target names and declared types."""

from astrolake.operators import frames as R


def test_synonyms_and_declared_types(spark):
    rows = [
        (1, "c 33", None), (2, "Caldwell_33", ""), (3, " rosette   nebula", "  "), (4, "Rosette_Cluster", "Reflection Nebula"), (5, "m-42", "comet"), (6, "somewhere", "Comet"),
        (7, None, None), (8, "", "double_star"), (9, "PLEIADES", "galaxy"), (9, "PLEIADES", "galaxy"), (10, "some_where", None)]
    df = spark.createDataFrame(rows, "id int, name string, declared string")
    got = {(r.id, r.catalog_id, r.target_type, r.type_source, r.star_dominant) for r in R.with_resolved_type(df, R.target_catalogue(spark), "name", "declared").collect()}
    assert got == {
        (1, "NGC6992", "emission_nebula", "catalogue", False), (2, "NGC6992", "emission_nebula", "catalogue", False), (3, "NGC2237", "emission_nebula", "catalogue", False),
        (4, "NGC2244", "reflection_nebula", "declared", False), (5, "M42", "emission_nebula", "catalogue", False), (6, "SOMEWHERE", "comet", "unknown_type", False),
        (7, "", "emission_nebula", "guess", False), (8, "", "double_star", "declared", True), (9, "M45", "galaxy", "declared", True), (10, "SOME_WHERE", "emission_nebula", "guess", False)}
    assert R.with_resolved_type(df.where("false"), R.target_catalogue(spark), "name", "declared").count() == 0
