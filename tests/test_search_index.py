from pyspark.sql import functions as F

from symgraph.operators import search as S

ROWS = [
    (1, "apache license", "version two of the apache license"), (2, "license", "apache"), (3, None, None), (4, "Ápache—License apache license apache", ""), (5, "the the the", "license of the apache foundation"), (6, "words only", "nothing else"),
]
QUERIES = ["license", "apache_license", "apache license OR foundation", "the", "the_the", "OR", "absent", "apache_license_apache OR words"]


def test_postings_answer_as_the_texts_do(spark):
    docs = spark.createDataFrame(ROWS, "id long, title string, body string").cache()
    index, lengths = S.write_index(docs, "id", ["title", "body"])
    for query in QUERIES:
        for where in (None, F.col("id") > 1):
            kept = docs.where(where).select("id") if where is not None else None
            a = S.search(docs, query, "id", ["title", "body"], where, limit=3).collect()
            b = S.search_index(index, lengths, query, "id", kept, limit=3).collect()
            assert sorted(a) == sorted(b), query
    ids = lambda q: {r.id for r in S.search(docs, q, "id", ["title", "body"]).collect()}
    assert ids("apache_license") == {1, 4} and ids("license_apache") == {4} and ids("the_the") == {5}


def test_names_and_endings(spark):
    nodes = spark.createDataFrame([("UserService", "class", "a"), ("userservice", "class", "b"), ("UserService", "method", "a"), ("Userx", "class", "a")], "name string, kind string, module string")
    assert S.named(nodes, "UserService").count() == 2 and S.named(nodes, "UserService", "class", "a").count() == 1
    assert S.named_like_the_end(nodes, "SERVICE").count() == 2
