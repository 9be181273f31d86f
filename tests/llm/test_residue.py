import pytest

from corpusmill.functions.sites import site
from corpusmill.llm.residue import residue

SCHEMA = "page_id string, origin string, blocks array<struct<kind:string,text:string,cells:array<string>,anchors:array<struct<label:string,href:string>>>>, status_code string, failure_reason string, template string, b int"
LONG = "The archive of the town holds letters and maps that nobody has opened for many years, and its keepers like it so. " * 4


def run(spark, rows):
    df = spark.createDataFrame([(i, o, [(k, t, None, [(t, "x")] if a else []) for k, t, a in b] if b is not None else None, s, f, "clash", 2) for i, o, b, s, f in rows], SCHEMA)
    return {r.page_id: r.reasons for r in residue(df, "page_id", site("origin"), "blocks", "status_code", "failure_reason").collect()}


def para(*texts):
    return [("paragraph", t, False) for t in texts]


NAV = [("listItem", t, True) for t in ("Home", "Pricing", "Contact us")]


def test_cases_and_hard_negatives(spark):
    rows = [
        ("v1", "a.example", para(LONG, "Welcome to {{company_name}} today"), "200", None),
        ("v2", "a.example", para(LONG + "by __CITY__ and more"), None, None),
        ("v3", "a.example", para(LONG, "Hello <%= page.copy %>"), "200", None),
        ("v4", "b.example", para(LONG, "[Add 2-3 sentences on product benefits]"), "200", None),
        ("v5", "b.example", para(LONG, "from ${city} and", "from ${city} again"), "200", None),
        ("v6", "b.example", para(LONG, "{{city}}"), "200", None),
        ("v7", "b.example", para(LONG, "shops in [City] open"), "200", None),
        ("code", "b.example", [*para(LONG), ("code", "{{x}} ${y} %%z%%", False)], "200", None),
        ("note", "b.example", para(LONG, "as he said [sic] and so on (see [1] and [Smith](x))", "a {1} and 50%% off, x__y"), "200", None),
        ("f1", "c.example", para(LONG, "Nisi amet veniam adipiscing commodo perula aliqua irure perula castrae"), "200", None),
        ("f2", "c.example", [*para(LONG), ("code", "test tbd zxcv copy blah here asdf dummy foo goes", False)], "200", None),
        ("writes", "c.example", para(LONG, "Designers at Hall drop lorem ipsum into the draft and replace it before review."), "200", None),
        ("d1", "c.example", para("Your headline goes here", "Add your description in this text box"), "200", None),
        ("d2", "c.example", [("heading", "TODO: title", False), *para("TBD - copy from marketing")], "200", None),
        ("hint", "d.example", para(LONG * 2, "Some features need JavaScript turned on."), "200", None),
        ("about", "d.example", para(LONG * 2, "When it shows a page not found message, check the redirect first."), "404", "http_error"),
        ("short", "d.example", para("How Vale helps clerks", "Keep the rollout unsigned; clerks will compare the payment in real time."), "200", None),
        ("empty", "d.example", [], "404", "timeout"),
        ("null", "d.example", None, "500", None),
        ("blank", "d.example", [("paragraph", "  ", False), ("paragraph", None, False)], "404", None),
        (None, "d.example", para("404 page not found"), "404", None),
        ("nosite", None, [*para("Access denied", "You do not have permission to view this."), *NAV], "0", None),
        ("one", "e.example", [*para("Please enable JavaScript to use Example"), *NAV], None, None),
    ]
    rows += [(f"t{k}", f"{'xyz'[k % 3]}ville.example", [("heading", f"Lost the way {k}", False), *para(f"The map of {'xyz'[k % 3]}ville has no such place. Reload it."), *NAV], "404" if k % 2 else "200", None) for k in range(6)]
    rows += [(f"m{k}", f"mirror{k}.example", para("Spring fair", "The spring fair of the valley opens on Sunday with music and cake."), "200", None) for k in range(6)]
    got = run(spark, rows + rows[:6])
    want = {"v1", "v2", "v3", "v4", "v5", "v6", "v7", "f1", "f2", "d1", "d2", "nosite", "one"} | {f"t{k}" for k in range(6)}
    assert set(got) == want
    assert got["v1"] == ["variable"] and got["f2"] == ["filler"] and got["d1"] == ["default"] and got["t0"] == ["notice"]


@pytest.mark.parametrize("text", ["Page not found", "Something went wrong. Reload to try again.", "Error establishing a database connection", "Gateway timed out", "Loading… If nothing happens, activate JavaScript in your browser settings and refresh.", "This content is no longer available"])
def test_said_outright(spark, text):
    assert run(spark, [("p", "a.example", para(text), None, None)]) == {"p": ["notice"]}


LOST = "Die angeforderte Seite wurde leider nicht gefunden, vielleicht hat der Verweis einen Fehler. "


def test_templates_by_alignment(spark):
    """No word of these is in a list: what counts is that nothing else is on the page and that it fails, or that one site shows it again and again."""
    rows = [(f"g{k}", f"{'uvw'[k % 3]}dorf.example", [("heading", "Nichts da", False), *para(LOST * 8), *NAV], "404" if k < 2 else "200", None) for k in range(6)]
    rows += [(f"p{k}", f"{'uv'[k % 2]}burg.example", [("heading", "La page est introuvable", False), *para(f"Retour vers {'uv'[k % 2]}burg {k}"), *NAV], None, None) for k in range(6)]
    # articles in which only some texts recur, however often
    rows += [(f"a{k}", f"{'uvw'[k % 3]}stadt.example", para("Von der Redaktion", f"Bericht {'abcdef'[k]} vom Markt und seinen Leuten."), "404", None) for k in range(6)]
    assert run(spark, rows) == {**{f"g{k}": ["notice"] for k in range(6)}, **{f"p{k}": ["template"] for k in range(6)}}


def test_slots_retain_names_in_marks_of_any_shape(spark):
    rows = [(f"s{k}", "a.example", para(LONG, f"Dear {{{{customer_name}}}}, see {k}"), "200", None) for k in range(3)]
    odd = ["to <<customer_name>> now", "to &lt;customer_name&gt; now", "to #CUSTOMER_NAME# now", "to { customer name } now", "to $CUSTOMER_NAME now", "to ~~customer_name~~ now"]
    rows += [(f"o{k}", "b.example", para(LONG, t), "200", None) for k, t in enumerate(odd)]
    rows += [(f"x{k}", "c.example", para(LONG, t), "200", None) for k, t in enumerate(["to <<other name>> now", "the field customer_name is empty", "#customers #names", "costs $300 or $USD"])]
    got = run(spark, rows)
    assert set(got) == {f"s{k}" for k in range(3)} | {f"o{k}" for k in range(len(odd))}


def test_default_words_inside_a_title_are_no_default(spark):
    assert run(spark, [("p", "a.example", para(LONG, "Default paragraph checks for tourism", "Sample text for clerks"), "200", None)]) == {}


def test_empty(spark):
    assert run(spark, []) == {}
