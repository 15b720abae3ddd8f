from pyspark.sql import functions as F

from veska.llm.names import Names, fold, match_names, near, parted, unmatched

MO = [
    (1, 10, ["Истоправский", "Истоправо"]), (2, 10, ["Горелинск", "Горелинск"]), (3, 20, ["Горелинский", "Горелинка"]),
    (4, 10, ["Двойновский", "Двойново"]), (5, 20, ["Двойновский", "Двойновка"]), (6, 20, None), (7, None, ["Щукинобск", None]),
]
REGIONS = [(10, "Первомайская область"), (20, "Республика Верхония")]
CASES = {
    ("Истоправский муниципальный район", None): [1], ("ИСТОПРАВСКОГО РАЙОНА", None): [1], ("р-н истоправский", None): [1], ("^Истоправский м.р-н.*", None): [1],
    ("Иcтoпpaвcкий район", None): [1], ("Istopravskiy rayon", None): [1], ("Истоправскй район", None): [1], ("Истопарвский", None): [1], ("рп Истоправо", None): [1],
    ("г. Горелинск", None): [2], ("городской округ город Горелинск", None): [2], ("Горелинский район", None): [3], ("  ГО  Горелинск ", None): [2],
    ("Двойновский район", "Первомайская обл."): [4], ("Двойновский район", "респ. Верхония"): [5], ("Двойновский район (Республика Верхония)", "Первомайская область"): [5],
    ("Двойновский район", None): [4, 5], ("shchukinobsk", None): [7], ("Непонятск", None): [], ("н/д", None): [], ("", None): [], ("-" * 5000, None): [], ("слово " * 3000, None): [],
}


def frames(spark):
    mo = spark.createDataFrame(MO, "code bigint, region_code bigint, names array<string>")
    return mo, spark.createDataFrame(REGIONS, "region_code bigint, region_name string")


def test_matches(spark):
    rows = [(t, b, i, "x") for i, (t, b) in enumerate(CASES)] * 2 + [(None, "y", 1, "x")]
    values = spark.createDataFrame(rows, "text string, beside string, code int, score string")
    got = {(r.text, r.beside): r for r in match_names(values, *frames(spark)).collect()}
    assert {k: list(r.codes) for k, r in got.items()} == CASES
    assert got["Истоправский муниципальный район", None].score == 1.0 and 0 < got["Истопарвский", None].score < 1 and got["н/д", None].score == 0


def test_blocks_give_the_same(spark, monkeypatch):
    import veska.llm.names as nm

    values = spark.createDataFrame([(t, b) for t, b in CASES], "text string, beside string")
    monkeypatch.setattr(nm, "BLOCK", 2)
    got = {(r.text, r.beside): list(r.codes) for r in match_names(values, *frames(spark)).collect()}
    assert got == CASES


def test_empty(spark):
    mo, regions = frames(spark)
    values = spark.createDataFrame([("Горелинск", None)], "text string, beside string")
    assert match_names(values.limit(0), mo, regions).count() == 0
    assert list(match_names(values, mo.limit(0), regions.limit(0)).first().codes) == []


def test_unmatched(spark):
    values = spark.createDataFrame([("Ничейск", None, "f"), ("Ничейск", None, "f"), ("Горелинск", None, "f"), (None, None, "f")], "text string, beside string, field string")
    m = match_names(values, *frames(spark)).select(F.col("text").alias("t"), "codes")
    got = unmatched(values.join(m, F.col("text") == F.col("t")), ["field"]).collect()
    assert [(r.field, r.text, r.rows) for r in got] == [("f", "Ничейск", 2)]


def test_pieces():
    assert near("abcd", "abdc") and near("abcd", "abd") and near("abcd", "abxd") and near("abcd", "abccd") and not near("abcd", "dcba") and not near("ab", "abcd")
    assert parted("Х район (Тестовая область)") == ("Х район  ", "Тестовая область") and parted("Х (бывший У)")[1] == ""
    assert fold("Pайон") == "район"
    n = Names([(1, (("старая", "noun"), ("руса", "noun"))), (2, (("руса", "noun"),))])
    assert [(m[2], m[4]) for m in n.mentions("г. старая руса")] == [("стар", 1), ("руса", None)]
    assert n.resolve("г. Старая Руса")[0] == {1} and n.resolve("Руса")[0] == {2} and n.resolve("Новая Руса")[0] == {2}


LONG = [(1, 10, ["Верхняя Пышма"]), (2, 10, ["Нижний Новгород"]), (3, 10, ["Великий Новгород"]), (4, 10, ["Нижний Тагил"]), (5, 10, ["Комсомольск на Амуре"])]


def test_names_of_several_words(spark):
    mo = spark.createDataFrame(LONG, "code bigint, region_code bigint, names array<string>")
    regions = spark.createDataFrame(REGIONS, "region_code bigint, region_name string")
    cases = {
        "г. Верхняя Пышма": [1], "город Верхней Пышмы": [1], "Верхняя Салда": [], "Нижний Новгород": [2], "Nizhniy Novgorod": [2], "Великий Устюг": [], "Великий Новгород": [3],
        "в Нижнем Тагиле": [4], "Нижний Тагли": [4], "Тагил": [], "Комсомольск на Амуре": [5], "Тагил Нижний": [4],
    }
    values = spark.createDataFrame([(t, None) for t in cases], "text string, beside string")
    assert {r.text: list(r.codes) for r in match_names(values, mo, regions).collect()} == cases


def test_similarity_is_a_threshold_and_not_a_length(spark):
    """A slip in a word of four letters leaves less than LEAST, in one of five just LEAST."""
    n = Names([(1, (("омск", "noun"),)), (2, (("пенза", "noun"),))])
    assert n.resolve("омскк")[1] == 0.8 and n.resolve("омк")[0] == set() and n.resolve("пензаа")[0] == {2}


def test_the_longest_mention_wins_in_any_blocks(spark, monkeypatch):
    import veska.llm.names as nm

    mo = spark.createDataFrame([(k, 10, [n]) for k, n in enumerate(["Горск", "Новогорелинск", "Верхняя Пышма"])], "code bigint, region_code bigint, names array<string>")
    regions = spark.createDataFrame(REGIONS, "region_code bigint, region_name string")
    values = spark.createDataFrame([("Горск, Новогорелинск", None), ("Новогорелинск и Горск", None), ("Горск рядом с Верхней Пышмой", None)], "text string, beside string")
    for block in (100, 1):
        monkeypatch.setattr(nm, "BLOCK", max(block, 2))
        got = {r.text: list(r.codes) for r in match_names(values, mo, regions).collect()}
        assert got == {"Горск, Новогорелинск": [1], "Новогорелинск и Горск": [1], "Горск рядом с Верхней Пышмой": [2]}
