from pyspark.sql import functions as F

from rampart.operators import features as FT


def _df(spark):
    rows = [(1, "/b", "x"), (2, "/a", None), (3, "/b", "yy"), (4, "/c", "x"), (5, None, "zzz")]
    return spark.createDataFrame(rows, "id BIGINT, URL STRING, token STRING")


def test_lengths(spark):
    got = {r["id"]: (r["lenToken"], r["lenURL"]) for r in FT.add_lengths(_df(spark)).collect()}
    assert got == {1: (1, 2), 2: (-1, 2), 3: (2, 2), 4: (1, 2), 5: (3, 3)}


def test_codes_are_sorted_and_gapless(spark):
    labels = FT.fit_labels(_df(spark), ["URL", "token"])
    got = {(r["column"], r["label"]): r["code"] for r in labels.collect()}
    assert got == {("URL", "/a"): 0, ("URL", "/b"): 1, ("URL", "/c"): 2, ("URL", "nan"): 3,
                   ("token", "nan"): 0, ("token", "x"): 1, ("token", "yy"): 2, ("token", "zzz"): 3}


def test_update_keeps_codes_and_refit_resorts(spark):
    df = _df(spark)
    known = FT.fit_labels(df.where(F.col("id") <= 2), ["URL"])
    upd = {r["label"]: r["code"] for r in FT.update_labels(known, df, ["URL"]).collect()}
    assert upd == {"/a": 0, "/b": 1, "/c": 2, "nan": 3}
    known2 = FT.fit_labels(df.where(F.col("id") >= 4), ["URL"])   # /c, nan
    upd2 = {r["label"]: r["code"] for r in FT.update_labels(known2, df, ["URL"]).collect()}
    assert upd2 == {"/c": 0, "nan": 1, "/a": 2, "/b": 3}
    refit = {r["label"]: r["code"] for r in FT.update_labels(known2, df, ["URL"], refit=True).collect()}
    assert refit == {"/a": 0, "/b": 1, "/c": 2, "nan": 3}


def test_encode_unseen_and_scale(spark):
    df = _df(spark)
    labels = FT.fit_labels(df.where(F.col("id") <= 3), ["URL"])
    enc = {r["id"]: r["URL_code"] for r in FT.encode(df, labels, ["URL"]).collect()}
    assert enc == {1: 1, 2: 0, 3: 1, 4: -1, 5: -1}
    sc = FT.fit_scaler(df, ["id"])
    row = sc.collect()[0]
    assert abs(row["mean"] - 3.0) < 1e-12 and abs(row["std"] - 2 ** 0.5) < 1e-12
    scaled = [r["id_s"] for r in FT.scale(df, sc, ["id"], "_s").orderBy("id").collect()]
    assert abs(scaled[0] + 2 ** 0.5) < 1e-12
    const = spark.createDataFrame([(1.0,), (1.0,)], "v DOUBLE")
    assert [r["v"] for r in FT.scale(const, FT.fit_scaler(const, ["v"]), ["v"]).collect()] == [0.0, 0.0]


def test_encode_with_store_grows_dictionary(spark, tmpdir_path):
    from rampart.plans.detect import encode_with_store
    df = _df(spark)
    path = tmpdir_path + "/labels"
    first = encode_with_store(spark, df.where(F.col("id") <= 2), ["URL"], path)
    assert sorted(r["URL_code"] for r in first.collect()) == [0, 1]
    second = encode_with_store(spark, df, ["URL"], path)
    got = {r["id"]: r["URL_code"] for r in second.collect()}
    assert got[2] == 0 and got[1] == 1 and got[3] == 1 and {got[4], got[5]} == {2, 3}


def test_encode_small_input_equals_plain(spark):
    df = _df(spark)
    labels = FT.fit_labels(df.where(F.col("id") <= 3), ["URL", "token"])
    a = sorted(tuple(r) for r in FT.encode(df, labels, ["URL", "token"]).collect())
    b = sorted(tuple(r) for r in FT.encode(df, labels, ["URL", "token"], small_input=True).collect())
    assert a == b
