"""The cascade of city strategies on small cases worked out by hand."""

from gondola.operators import city_choice

SITES = [("http://a.com/", "São José"), ("http://b.com/", "Gaspar"), ("http://c.com/", "Gaspar"), ("http://d.com/", " "), ("http://e.com/", "Gaspar"), ("http://f.com/", "Gaspar"), (None, "x"), ("http://a.com/", "São José")]


def contexts(spark, sites=SITES, own=True):
    frame = spark.createDataFrame
    links = frame([("http://a.com/", 1, "Blog", "http://a.com/blog"), ("http://a.com/", 2, " sao  JOSE ", "http://a.com/loja/sao-jose"), ("http://a.com/", 0, "São José", "http://other.com/sao-jose"), ("http://f.com/", 1, None, "http://f.com/q")], "site string, seq int, text string, href string")
    triggers = frame([("http://b.com/", k, "Menu", False, True) for k in range(20)] + [("http://b.com/", 50, "Trocar loja", False, True), ("http://b.com/", 51, "Selecionar cidade", True, False), ("http://c.com/", 1, "Trocar loja", False, True), ("http://a.com/", 1, "Trocar loja", False, True), ("http://b.com/", 52, None, True, True)], "site string, seq int, text string, is_select boolean, visible boolean")
    options = frame([("http://b.com/", 50, 1, "Gaspar", False, True), ("http://b.com/", 50, 2, "Unidade Gaspar Centro", True, True), ("http://b.com/", 50, 3, "Gaspar", True, False), ("http://b.com/", 51, 1, "Gaspar", False, True), ("http://b.com/", 19, 1, "Gaspar", False, True), ("http://c.com/", 1, 1, "Blumenau", False, True), ("http://a.com/", 1, 1, "São José", False, True)], "site string, trigger int, seq int, text string, in_select boolean, visible boolean")
    labels = frame([("http://a.com/", "generic-city-trigger", "never shown")], "site string, strategy string, label string")
    known = frame([("http://e.com/", "store-selector", "Loja de Gaspar", "gaspar", "http://e.com/s"), ("http://c.com/", "store-selector", "Loja de Itajai", "Itajaí", "http://c.com/s")], "site string, strategy string, storeLabel string, effectiveCity string, contextUrl string")
    rows = city_choice.contexts(frame(sites, "site string, requestedCity string"), links, triggers, options, labels, known if own else None)
    return {r["site"]: tuple(r)[1:] for r in rows.collect()}


def test_strategies_in_order(spark):
    found = contexts(spark)
    assert found == {
        "http://a.com/": ("generic-city-directory", "sao JOSE", "São José", "http://a.com/loja/sao-jose", "match", True),
        "http://b.com/": ("generic-city-trigger", "Unidade Gaspar Centro", "Gaspar", None, "match", True),
        "http://c.com/": ("store-selector", "Loja de Itajai", "Itajaí", "http://c.com/s", "mismatch", False),
        "http://d.com/": ("default", None, None, None, "default", True),
        "http://e.com/": ("store-selector", "Loja de Gaspar", "Gaspar", "http://e.com/s", "match", True),
        "http://f.com/": ("city-selection-unavailable", None, None, None, "unknown", False),
    }


def test_nothing_known_and_nothing_asked(spark):
    assert contexts(spark, own=False)["http://c.com/"] == ("city-selection-unavailable", None, None, None, "unknown", False)
    assert contexts(spark, sites=[("http://d.com/", None)])["http://d.com/"][0] == "default"
    assert contexts(spark, sites=[(None, None)]) == {}


def test_at_most_twelve_triggers_the_best_first(spark):
    frame = spark.createDataFrame
    triggers = frame([("s", k, f"Entrega {k}", k % 2 == 1, k != 3) for k in range(40)], "site string, seq int, text string, is_select boolean, visible boolean")
    got = [r["trigger"] for r in city_choice.best_triggers(frame([("s",)], "site string"), triggers).orderBy("rank").collect()]
    assert got == [k for k in range(40) if k % 2 and k != 3][:12]
