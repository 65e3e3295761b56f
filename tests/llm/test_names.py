import pytest

from litmill.llm import name_variants as nv


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Doe, Jane", ("doe", "jane")), ("Dr. Jane Doe, PhD", ("doe", "jane")), ("Jane  DOE", ("doe", "jane")), ("Bob Doe", ("doe", "bob")), ("Doe, Ming-Wei", ("doe", "mingwei")),
        ("Mingwei Doe", ("doe", "mingwei")), ("Anthony von Doe", ("von doe", "anthony")), ("Doe, Anthony von", ("von doe", "anthony")), ("Łukasz Doé", ("doe", "lukasz")),
    ],
)
def test_people(name, want):
    assert nv.parse_person(name)[:2] == want


@pytest.mark.parametrize(("name", "want"), [("Doe J", "j"), ("J. Doe", "j"), ("J.R. Doe", "jr"), ("Doe, J. R.", "jr"), ("Doe JR", "jr"), ("Doe MA", "ma")])
def test_initials(name, want):
    assert nv.parse_person(name)[:3] == ("doe", "", want)


def test_rewritings():
    assert nv.rewritten_person("Bob Doe", "doe", "bob") == [("doe", "robert", 1.0), ("bob", "doe", 0.8)]
    assert [x[1] for x in nv.rewritten_person("Doe, Sam", "doe", "sam")] == ["samuel", "samantha"] and nv.rewritten_person("Doe, J.", "doe", "") == []
    assert nv.rewritten_person("Sam-Lee Doe", "doe", "samlee")[0][1] == "samuellee" and nv.rewritten_person("Samson Doe", "doe", "samson") == [("samson", "doe", 0.8)]
    assert nv.read_organisation("Inst. Med., Foo")[1] == [("institute medicine", "foo"), ("institute medical", "foo"), ("institution medicine", "foo"), ("institution medical", "foo")]


def test_several_rewritings(spark):
    """A nickname follows the full name that is known; between two it follows the one that is clearly more common, else none."""
    people = {"Samantha Ferdapal": 9, "Sam Ferdapal": 2, "Samuel Buswin": 9, "Samantha Buswin": 9, "Sam Buswin": 1, "Buswin, Sam": 1, "Patrick Lakwagis": 9, "Patricia Lakwagis": 1, "Pat Lakwagis": 2,
              "Bob Hanstorp": 1, "Robert Hanstorp": 1, "Bobby Midlorus": 1, "Bob Midlorus": 1, "Zorka, Ann": 5, "Zorka, Otto": 5, "Zorka Ann": 1, "Ann, Bor": 1}
    orgs = {"Foo Institution of Medical Physics": 3, "Foo Inst. of Med. Physics": 1, "Bar Inst. of Med. Physics": 1, "Bar Institute of Medicine Physics": 4, "Bar Institute of Medical Physics": 4}
    df = spark.createDataFrame([("person", k, n) for k, n in people.items()] + [("organisation", k, n) for k, n in orgs.items()], "kind string, name string, n bigint")
    named = nv.entities(df)
    got = {frozenset((r.name_a, r.name_b)) for r in nv.variant_pairs(named).collect()}
    want = [("Samantha Ferdapal", "Sam Ferdapal"), ("Sam Buswin", "Buswin, Sam"), ("Patrick Lakwagis", "Pat Lakwagis"), ("Bob Hanstorp", "Robert Hanstorp"), ("Bobby Midlorus", "Bob Midlorus"), ("Zorka, Ann", "Zorka Ann"),
            ("Foo Institution of Medical Physics", "Foo Inst. of Med. Physics")]
    assert got == {frozenset(x) for x in want}
    scores = {r.name: r.score for r in named.collect()}
    assert scores["Samantha Ferdapal"] == 1 and 0.5 <= scores["Pat Lakwagis"] < scores["Sam Ferdapal"] < 1


def test_organisations():
    same = ["University of Foo", "Foo University", "Univ Foo", "Univeristy of Foo", "University of Foo, Department of Bar", "Dept. of Bar, Univ. of Foo", "UNIVERSITY  OF FOO"]
    assert len({nv.parse_organisation(n) for n in same}) == 1
    assert nv.parse_organisation("Foo General Hospital") != nv.parse_organisation("Foo Academy of Sciences")
    assert nv.parse_organisation("Foo Inst. of Brain Science (FIBS)") == nv.parse_organisation("Institute of Brain Science, Foo")


def test_slips():
    assert nv.slip_kind("anais", "anias") == 2 and nv.slip_kind("sammuel", "samuel") == 2 and nv.slip_kind("lena", "lene") == 1
    assert nv.slip_kind("abc", "abc") == 0 and nv.slip_kind("kitten", "sitting") == 0 and nv.slip_kind("moor", "mur") == 2


def test_linking(spark):
    people = {"Samuel Ferdapal": 9, "Dr. Samuel Ferdapal": 3, "Sammuel Ferdapal": 1, "Ferdapal, S.": 2, "Ulrich Ferdapal": 5, "Lena Lakwagis": 5, "Lene Lakwagis": 5, "Lakwagis, L.": 1,
              "Lena Other": 2, "Lene Another": 2, "The Open Group": 1, "the open group": 1, "Samuel Buswin": 4, "X": 1}
    rows = [("person", k, n) for k, n in people.items()] + [("organisation", "Univ Foobar", 2), ("organisation", "University of Foobar", 9), ("organisation", "University of Foobra", 1), ("organisation", "Foobar General Hospital", 1)]
    df = spark.createDataFrame(rows, "kind string, name string, n bigint")
    got = {(r.name_a, r.name_b) for r in nv.variant_pairs(nv.entities(df)).collect()}
    sam = ["Dr. Samuel Ferdapal", "Ferdapal, S.", "Sammuel Ferdapal", "Samuel Ferdapal"]
    want = {(a, b) for a in sam for b in sam if a < b} | {("The Open Group", "the open group")}
    uni = ["Univ Foobar", "University of Foobar", "University of Foobra"]
    assert got == want | {(a, b) for a in uni for b in uni if a < b}


def test_sources_with_gaps(spark):
    authors = spark.createDataFrame([(1, [(" Ann Doe ", 1, ["U", None, " "]), (None, 2, None)]), (2, None), (3, [])], "paper_id int, authors array<struct<name:string,sequence:int,affiliations:array<string>>>")
    cites = spark.createDataFrame([(1, {"citation_author": ["Ann Doe", " ", None]}), (2, None)], "record_id bigint, meta map<string,array<string>>")
    got = {(r.kind, r.name): r.n for r in nv.distinct_names(authors, cites).collect()}
    assert got == {("person", "Ann Doe"): 2, ("organisation", "U"): 1}
    empty = nv.distinct_names(authors.limit(0), cites.limit(0))
    assert nv.variant_pairs(nv.entities(empty)).count() == 0


def test_slipped_surname_beside_several_names(spark):
    """A slip of a surname that occurs with several people, one of them with a slipped given name; a surname with names of its own is none."""
    people = {"Samuel Devgotek": 85, "Andre Devgotek": 36, "Paula Devgotek": 40, "Samuel Devvgotek": 3, "Andre Devvgotek": 4, "Sammuel Devvgotek": 1, "Sammuel Ferdapal": 1, "Samuel Ferdapal": 9,
              "Samuel Buswin": 4, "Samuel Lakwagis": 4, "Samuel Hanstorp": 9, "Andre Hanstorp": 9, "Paula Hanstorp": 9, "Samuel Hansttorp": 5, "Otto Hansttorp": 5}
    df = spark.createDataFrame([("person", k, n) for k, n in people.items()], "kind string, name string, n bigint")
    got = {(r.name_a, r.name_b) for r in nv.variant_pairs(nv.entities(df)).collect()}
    sam = ["Sammuel Devvgotek", "Samuel Devgotek", "Samuel Devvgotek"]
    want = {(a, b) for a in sam for b in sam if a < b} | {("Andre Devgotek", "Andre Devvgotek"), ("Sammuel Ferdapal", "Samuel Ferdapal")}
    assert got == want
