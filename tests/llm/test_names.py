import pytest

from tidemark.llm import names as N
from tidemark.llm import resolve as R


@pytest.mark.parametrize("name,kind,stem,fields", [
    ("Tadelogen Biosciences Co.,Ltd", "company", "tadelogen", {"biosciences"}), ("Biosciences, Tadelogen", "company", "tadelogen", {"biosciences"}),
    ("BepalilexGen. Corporation", "company", "bepalilex", {"genomics"}), ("Monolumalan BP (Wuhan)", "company", "monolumalan", {"bioprocess"}), ("Kelidotris Bio LLC", "company", "kelidotris", {"biosciences", "biologics"}),
    ("Tomesoxan Company Limited", "company", "tomesoxan", set()), ("The Univ. of Lodelosel", "university", "lodelosel", set()), (" of Lodelosel, U.", "university", "lodelosel", set()),
    ("Banolunequin U. Hospital", "hospital", "banolunequin", set()), ("institute of medicine, nonadocyte", "institute", "nonadocyte", {"medicine"}), ("Naramidaxan Research Inst", "institute", "naramidaxan", {"research"}),
    ("Sanadoilnex Centre for Rsch", "center", "sanadoilnex", {"research"}), ("ZrolupolBP Gmbh", "company", "zrolupol", {"bioprocess"}),
])
def test_bodies(name, kind, stem, fields):
    n = N.parse(name)
    assert (n.kind, n.stem, set(n.fields)) == (kind, stem, fields)


@pytest.mark.parametrize("name,surname,given,initial", [
    ("Dr. Bill Nizoralavex Lab.", "nizoralavex", {"william"}, ""), ("Dezemoorlan, Anthony (Research Group)", "dezemoorlan", {"anthony"}, ""), ("lab of j. xequilohedor", "xequilohedor", set(), "j"),
    ("GONERIDELEX LAB. (JOSEPHINE)", "goneridelex", {"josephine"}, ""), ("PROF WILLIAM DEZEMOORLAN", "dezemoorlan", {"william"}, ""), ("Ted Felenodoter's Laboratories", "felenodoter", {"theodore"}, ""),
])
def test_persons(name, surname, given, initial):
    n = N.parse(name)
    assert (n.kind, n.stem, set(n.given), n.initial) == ("person", surname, given, initial)


@pytest.mark.parametrize("name", [None, "", "-", "n/a", "not disclosed", "Unknown partner", "a top-20 drug maker", "several laboratories", "TBC"])
def test_nobody(name):
    assert N.parse(name).kind == "nobody"


def test_slips_share_a_key():
    for a, b in (("tomesoxan", "tomesxan"), ("tomesoxan", "tomesoxaan"), ("tomesoxan", "tomseoxan"), ("tomesoxan", "tomesoxam"), ("cezoradex", "cezoeradex")):
        assert N.same_stem(a, b) and set(N.slips(a)) & set(N.slips(b))
    assert not N.same_stem("tomesoxan", "tomesivan")


COMPANIES = [
    ("c1", "Tomesoxan Immunology", ["Team Bravo", "TMXI", "Tomesoxan Immunol."]), ("c2", "Tomesoxan Immunology Ltd.", None), ("c3", "Keroluqubar Analytics", ["KQA"]), ("c4", "Keroluqubar Immunology", ["Keroluqubar Immuno"]),
    ("c5", "Banolunequin University Hospital / カタカナ", [None, ""]),
]
RELATIONS = [
    ("r1", "Tomesxan Immunol. Ltd"), ("r2", "TMXI"), ("r3", "Tomesoxan"), ("r4", "Keroluqubar"), ("r5", "Keroluqubar Anal."), ("r6", "カタカナ"), ("r7", "Bill Cebrafisyn Lab"), ("r8", "William Cebrafisin Research Group"),
    ("r9", "Anthony Cebrafisyn Laboratory"), ("ra", "W. Cebrafisyn Lab"), ("rb", None), ("rc", "undisclosed"), ("rd", "Zomirekor Labs"), ("re", "Zomirekor Reagents"), ("rf", "Old Kaneri"), ("rg", "old  kaneri"), ("r7", "Bill Cebrafisyn Lab"),
    ("rh", "x" * 50_000), ("ri", "team bravo"), (None, "team bravo"),
]
WANT = {
    ("c1", "c2"), ("c1", "r1"), ("c2", "r1"), ("c1", "r2"), ("c2", "r2"), ("c1", "r3"), ("c2", "r3"), ("c3", "r5"), ("c5", "r6"), ("r7", "r8"), ("r7", "ra"), ("r8", "ra"), ("rf", "rg"), ("c1", "ri"), ("c2", "ri"),
}


def frames(spark, c, r):
    a = spark.createDataFrame(c, "id string, display_name string, aliases array<string>").selectExpr("*", "1 as fid", "2 as root", "'x' as kind")
    b = spark.createDataFrame(r, "id string, organization string").selectExpr("*", "1 as fid", "'x' as spelling", "'y' as aliases")
    return a, b


def test_pairs(spark):
    got = {tuple(x) for x in R.found_pairs(R.resolve(*frames(spark, COMPANIES, RELATIONS))).distinct().collect()}
    assert got == WANT


def test_empty(spark):
    assert R.resolve(*frames(spark, [], [])).count() == 0
    # without a pool all are outside organisations: the bare names then have one bearer each
    got = {tuple(x) for x in R.found_pairs(R.resolve(*frames(spark, [], RELATIONS))).distinct().collect()}
    assert got == {("r1", "r3"), ("r4", "r5"), ("r7", "r8"), ("r7", "ra"), ("r8", "ra"), ("rf", "rg")}


def test_short_and_many_worded_stems():
    assert N.parse("Roche").stem == "roche" and N.parse("Thermo Fisher Scientific").stem == "thermofisherscientific"
    got = N.parse("North River Diagnostics")
    assert (got.kind, got.stem, got.fields) == ("company", "northriver", frozenset({"diagnostics"}))
    assert N.same_stem("roche", "roche") and not N.same_stem("roche", "roshe") and N.same_stem("northriver", "northrver")
    assert N.slips("roche") == ["roche"]
