"""Languages of texts whose letters stand alone."""

from loomwright.llm import langid


def test_langid_letters_alone(spark):
    rows = [(i, "the whing banana was in a barn " * 3, "aa") for i in range(1, 40)]
    rows += [(i, "中 国 是 一 个 国 家 " * 5, "bb") for i in range(40, 80)]
    alone = {900: "A.", 901: "1. a", 902: "中", 903: "a -- b ... n", 904: "中。。国", 905: "ж", 906: "1. !", 907: None}
    df = spark.createDataFrame(rows + [(i, t, None) for i, t in alone.items()], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[900][0] == got[901][0] == got[903][0] == "aa" and got[902][0] == got[904][0] == "bb"
    assert got[905][0] in ("aa", "bb") and got[906] == got[907] == ("und", 0.0)
    assert min(got[i][1] for i in (900, 901, 902, 903, 904)) > 0.5
