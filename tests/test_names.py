"""The learned recognizer of names, and masking by tables of names."""

import random

import pytest
from pyspark.sql import functions as F

from decorum import lexicon
from decorum.operators.names import learn_names, mask_learned, name_runs
from decorum.operators.privacy import mask_person

NEW = ["Zorbak", "Quillow", "Åsmund", "O’Dwyth", "Jean-Marq", "Tibbet"]
PLAIN = ["The river rose again.", "Some of it was lost", "We saw the Harbour from there.", "Nothing like Harbour fish, he thought.",
         "A Harbour is a good place", "And then the rain came", "GNU tools are fine", "harbour lights, harbour nights"]
PLACES = ["yesterday my cousin {} arrived", "so {} replied at once", "we thanked Dr. {} warmly", "a letter from uncle {} arrived"]


def planted(n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(lexicon.FIRST_NAMES if i % 2 else NEW) + rng.choice(["", "", " Smith"])
        place = PLACES[i // 2 % len(PLACES)]
        before, after = rng.choice(PLAIN), rng.choice(PLAIN)
        rows.append((i, f"{before}\n{place.format(name)}. {after}", f"{before}\n{place.format('<PERSON>')}. {after}"))
    return rows


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    df = spark.createDataFrame([*planted(), (None, None, None), (-1, "", "")], "id long, text string, want string")
    return learn_names(df, "text", str(tmp_path_factory.mktemp("names"))).persist()


def test_names_in_no_list_are_masked_and_nothing_else(spark, rules):
    df = spark.createDataFrame([*planted(400, seed=11), (None, None, None), (-1, "", "")], "id long, text string, want string")
    rows = mask_learned(df, "text", rules).collect()
    assert len(rows) == 402
    assert [(r.id, r.text) for r in rows if r.text != r.want] == []


def test_a_new_name_is_known_by_its_place_and_by_itself(spark, rules):
    names = {r.feature for r in rules.filter("view = 'name'").collect()}
    assert set(NEW) <= names and set(lexicon.FIRST_NAMES) <= names and not {"Harbour", "The", "GNU", "We"} & names
    texts = ["my cousin Xylo Brandt came", "Quillow knows", "the Harbour of Xylo", "MY COUSIN Xylo Brandt", "thanks, Mrs. Xylo"]
    got = [r.text for r in mask_learned(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text", rules).collect()]
    assert got == ["my cousin <PERSON> came", "<PERSON> knows", "the Harbour of Xylo", "MY COUSIN <PERSON>", "thanks, Mrs. <PERSON>"]


def test_runs_and_their_neighbours(spark):
    df = spark.createDataFrame([("we met Ann Lee yesterday. Bob met Cy",), ("Dr. Who said",), (None,)], "text string")
    got = {(r["before"], r["first"], r["after"], r.n) for r in name_runs(df, "text").collect()}
    assert got == {("met", "Ann", "yesterday", 1), ("", "Bob", "met", 1), ("met", "Cy", "", 1), ("dr.", "Who", "said", 1)}


def test_a_run_of_any_length_needs_no_stack(spark, rules):
    """All of a document may stand in capitals."""
    long = " ".join(["ZUR", "WELT", "ÅSEN", "O’CO"] * 5_000)
    texts = [f"my cousin {long} arrived", f"{long} quietly", f"{long} replied", f"{long} replied. 1Bo Lee replied"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert {(r["before"], r["first"], r["after"], r.n) for r in name_runs(df, "text").collect()} == {
        ("cousin", "ZUR", "arrived", 1), ("", "ZUR", "quietly", 1), ("", "ZUR", "replied", 2), ("", "Lee", "replied", 1)}
    assert [r.text for r in mask_learned(df, "text", rules).collect()] == [
        "my cousin <PERSON> arrived", texts[1], "<PERSON> replied", "<PERSON> replied. 1Bo <PERSON> replied"]
    john = spark.createDataFrame([(f"then John {long}, he",)], "text string")
    assert mask_person(john, "text").first().text == "then <PERSON>, he"


def test_nothing_to_learn_from(spark, tmp_path):
    none = learn_names(spark.createDataFrame([(None,), ("no capitals",)], "text string"), "text", str(tmp_path / "x"))
    assert {r.feature for r in none.filter("view = 'name'").collect()} == set(lexicon.FIRST_NAMES)


@pytest.mark.parametrize("in_row", [100, 1])
def test_a_table_of_names_masks_rows_without_id(spark, in_row):
    names = spark.createDataFrame([("Zorro",), ("Ann",), (None,), ("Zorro",)], "name string")
    rows = [(None, "I met Zorro here"), (None, "I met Zorro here"), (None, "Ann"), (1, "Zorro Lee, ann"), (1, None), (2, ""), (3, "Zorros Ann-Lee")]
    got = mask_person(spark.createDataFrame(rows, "id long, text string"), "text", names, "id", in_row=in_row).collect()
    want = [(None, "I met <PERSON> here"), (None, "I met <PERSON> here"), (None, "<PERSON>"), (1, "<PERSON>, ann"), (1, None), (2, ""), (3, "Zorros Ann-Lee")]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_a_stream_refuses_a_large_table_of_names(spark, tmp_path):
    spark.createDataFrame([("Ann",)], "text string").write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([("A",), ("B",)], "name string")
    sdf = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        mask_person(sdf, "text", names, in_row=1)
    assert mask_person(sdf, "text", F.upper).isStreaming
