"""End-to-end cases: config and HTML -> records."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pagequery import Config, ConfigError, extract, load_config


def one(query, clean=None):
    config = {"queries": {"q": query}}
    if clean is not None:
        config["clean"] = clean
    return config


def field(name="v", **rule):
    return {"name": name, "rule": {k: v for k, v in rule.items() if v is not None}}


def sel(selector, *fields, **more):
    return {"selector": selector, "extract": list(fields) or [field(text=True, aggregate=None)], **more}


def texts(selector, **rule):
    return one(sel(selector, field(text=True, **rule)))


BOATS = "".join(f'<tr class="boat row" data-no="{n}"><td><a href="/boats/{n}">{name}</a></td><td class="len">{n}.25 m</td></tr>' for n, name in ((4, "Heron"), (6, "Otter")))
GREEK = [("Delta", "4"), ("Gamma", "3"), ("Delta", "4")]

#: name, config, page, base url, records
CASES = [
    ("mixed fields", one(sel("tr.boat", field("link", attribute="href"), field("all", text=True), field("size", regex=r"([0-9]+\.[0-9]+) m", transform=["float"]))), BOATS, "", [{"link": [f"/boats/{n}"], "all": [f"{name}{n}.25 m"], "size": [n + 0.25]} for n, name in ((4, "Heron"), (6, "Otter"))]),
    ("raw regex int", one({"regex": r"depth=(\d+)", "extract": [field(transform=["int"], aggregate="first")]}), "depth=31 depth=8", "", [{"v": 31}, {"v": 8}]),
    ("count", one(sel("dt", field(aggregate="count"))), "<dl><dt>m<dt>n<dd>o</dl>", "", [{"v": 2}]),
    ("unique", one(sel("i.g", field(text=True, aggregate="unique"))), "".join(f'<i class="g">{a}</i>' for a, _ in GREEK), "", [{"v": ["Delta", "Gamma"]}]),
    ("join texts", one(sel("i", field(text=True, aggregate="join", join_sep="+"))), "".join(f"<i>{b}</i>" for _, b in GREEK), "", [{"v": "4+3+4"}]),
    ("last", one(sel("i", field(text=True, aggregate="last"))), "<i>m</i><i>n</i>", "", [{"v": "n"}]),
    ("absolute link", one(sel("a", field(attribute="href", transform=["urljoin"]))), '<a href="/maps/n">.</a>', "https://sea.test/ports/list", [{"v": ["https://sea.test/maps/n"]}]),
    ("letter case", one(sel("b", field("low", text=True, transform=["lowercase"]), field("up", text=True, transform=["uppercase"]))), "<b>NoRTH Öre</b>", "", [{"low": ["north Öre"], "up": ["NORTH ÖRE"]}]),
    ("missing and optional", one(sel("b", field("t", text=True), field("k", attribute="lang", optional=True))), "<b>kept</b>", "", [{"t": ["kept"], "k": None}]),
    ("missing", one(sel("b", field(attribute="lang"))), "<b>m</b>", "", [{"v": []}]),
    ("nothing selected", texts("tr.boat"), "<b>m</b>", "", []),
    ("one class of several", texts("b.hot"), "<b class='cold  hot'>1</b><b class=cold>2</b><b class='hotter'>3</b>", "", [{"v": ["1"]}]),
    ("all classes", texts("b.hot.dry"), "<b class='dry x hot'>1</b><b class=hot>2</b><i class='hot dry'>3</i>", "", [{"v": ["1"]}]),
    ("id", texts("b#mast"), "<b id=mast>1</b><i id=mast>2</i><b id=masts>3</b>", "", [{"v": ["1"]}]),
    ("id and class", texts("b#mast.tall"), "<b class='tall' id='mast'>1</b><b id=mast>2</b>", "", [{"v": ["1"]}]),
    ("id of any tag", one(sel("#chart", field(attribute="src"))), "<embed id=chart src=n.svg>", "", [{"v": ["n.svg"]}]),
    ("has attribute", texts("b[lang]"), "<b LANG=no>1</b><b>2</b>", "", [{"v": ["1"]}]),
    ("attribute value", texts("b[lang='no']"), "<b lang=nn>1</b><b lang=\"no\">2</b>", "", [{"v": ["2"]}]),
    ("value with blanks", texts('main b[title="two words"]'), "<b title='two words'>1</b><b title='two'>2</b>", "", [{"v": ["1"]}]),
    ("last part of a chain", texts("ul.menu li ~ b.k"), "<b class=k>1</b><b>2</b>", "", [{"v": ["1"]}]),
    ("void elements", one(sel("hr", field(attribute="title"))), "<p>x<hr title=m>y<hr title=n>", "", [{"v": ["m"]}, {"v": ["n"]}]),
    ("closes itself", texts("b.e"), "<b class='e'/>out<b class=e />", "", [{"v": [""]}, {"v": [""]}]),
    ("bound in quotes", texts("b"), "<b title='1 > 0'>m</b>", "", [{"v": ["m"]}]),
    ("script is no markup", texts("b"), "<b>m</b><script>w('<b>fake</b>')</script><b>n</b>", "", [{"v": ["m"]}, {"v": ["n"]}]),
    ("never closed", texts("b"), "<div><b>m<i>n</div>", "", [{"v": ["mn"]}]),
    ("references", one(sel("b", field("t", text=True), field("k", attribute="title"))), "<b title='m&amp;n&#61;1'>Oil &amp; rope &#8211; &gt;2</b>", "", [{"t": ["Oil & rope – >2"], "k": ["m&n=1"]}]),
    ("a comment in a text", texts("b"), "<b>wind<!-- <b>no</b> --> and tide</b>", "", [{"v": ["wind and tide"]}]),
    ("a token stays text", texts("b", transform=["trim"]), "<b> none </b>", "", [{"v": ["none"]}]),
    ("group beside a class", one({"regex": r"[<]knots[>] ([0-9]+)", "extract": [field()]}), "<knots> 17", "", [{"v": ["17"]}]),
    ("group without capture", one({"regex": r"(?:port|quay) ([a-z]+)", "extract": [field()]}), "port east quay west", "", [{"v": ["east"]}, {"v": ["west"]}]),
    ("inner closes first", one(sel("b", field(attribute="id"))), "<b id=outer><b id=inner></b></b>", "", [{"v": ["inner"]}, {"v": ["outer"]}]),
    ("first closed only", one(sel("b", field(attribute="id"), multiple=False)), "<b id=outer><b id=inner></b></b>", "", [{"v": ["inner"]}]),
    ("leaf and sieve decode", texts("b"), "<b>&amp;gt;</b>", "", [{"v": [">"]}]),
    ("leaf alone decodes", one(sel("b", field(text=True)), False), "<b>&amp;gt;</b>", "", [{"v": ["&gt;"]}]),
    ("aggregate as transform", texts("b", transform=["float", "last"]), "<b>3.5</b>", "", [{"v": ["3.500000"]}]),
    ("star", texts("*"), "<b>m</b>", "", []),
    ("class in brackets", texts('[class="m"]'), '<b class="m">m</b>', "", []),
    ("id in brackets", texts("[id]"), "<b id=m>m</b>", "", []),
    ("count of elements with matches", one(sel("b", field(regex="[a-f]", aggregate="count"))), "<b>face</b><b>77</b>", "", [{"v": 2}]),
    ("first element has none", one(sel("b", field(regex="n[0-9]", aggregate="first"))), "<b>q</b><b>n4</b>", "", [{"v": None}]),
    ("exists somewhere", one(sel("b", field(regex="n[0-9]", aggregate="exists"))), "<b>q</b><b>n4</b>", "", [{"v": True}]),
    ("join of lists", one(sel("u", field(regex="[3-5]", aggregate="join", join_sep="/"))), "<u>34</u><u></u><u>5</u>", "", [{"v": "3/4//5"}]),
    ("field beside an aggregate", one(sel("li", field("n", aggregate="count"), field("t", text=True))), "<ol><li>m<li>n</ol>", "", [{"n": 2, "t": ["m", "n"]}]),
    ("aggregates of nothing", one(sel("u", *[field(k, text=True, aggregate=k) for k in ("count", "exists", "first", "last", "unique", "join")])), "<b>m</b>", "", [{"count": 0, "exists": False, "first": None, "last": None, "unique": [], "join": ""}]),
    ("optional wins over count", one(sel("b", field(attribute="lang", optional=True, aggregate="count"), multiple=False)), "<b></b>", "", [{"v": None}]),
    ("regex in a match", one({"regex": "<(.*)>", "extract": [field("c", regex="[0-9]", aggregate="count"), field("e", regex="[0-9]", aggregate="exists"), field("m", regex="#"), field("f", regex="[0-9]", aggregate="first")]}), "<k8l9>", "", [{"c": 0, "e": False, "m": [], "f": "8"}]),
    ("attribute from below", one(sel("section", field(attribute="cite"))), "<section><i><q cite=src>m</q></i></section>", "", [{"v": ["src"]}]),
    ("attribute without value", one(sel("video", field(attribute="loop"))), "<video loop></video>", "", [{"v": [""]}]),
    ("tags leave no blank", texts("u"), "<u><b>ice</b><i>berg</i></u>", "", [{"v": ["iceberg"]}]),
    ("character data", texts("u"), "<u>1<![CDATA[<2>]]>3</u>", "", [{"v": ["1<2>3"]}]),
    ("list items end each other", texts("li"), "<ol><li>m<li>n</ol>", "", [{"v": ["m"]}, {"v": ["n"]}]),
    ("cells end each other", texts("th"), "<table><tr><th>m<th>n<tr><th>o</table>", "", [{"v": ["m"]}, {"v": ["n"]}, {"v": ["o"]}]),
    ("a block ends a paragraph", texts("p"), "<p>m<section>n</section>", "", [{"v": ["m"]}]),
    ("a rule ends none", texts("p"), "<p>m<hr>n</p>", "", [{"v": ["mn"]}]),
    ("substitution", texts("u", regex="[aeiou]", regex_sub="_", transform=["regex_sub"]), "<u>harbour</u>", "", [{"v": ["h_rb__r"]}]),
    ("substitution with parts", texts("u", regex="(k)", regex_sub="[$1$&$$]", transform=["regex_sub"]), "<u>ok</u>", "", [{"v": ["o[kk$]"]}]),
    ("queries in order of names", {"queries": {"zinc": sel("u", field("x", text=True)), "iron": sel("b", field("x", text=True))}}, "<u>z</u><b>i</b>", "", [{"x": ["i"]}, {"x": ["z"]}]),
    ("xpath", one({"xpath": "//b", "extract": [field(text=True)]}), "<b>m</b>", "", []),
    ("regex before selector", one({"selector": "b", "regex": "k([0-9])", "extract": [field()]}), "<b>m</b>k3", "", [{"v": ["3"]}]),
    ("text: false is a text leaf", one(sel("b", field(text=False))), "<b>m</b>", "", [{"v": ["m"]}]),
    ("default cleaning", one({"regex": "Name: (.*?)!", "extract": [field()]}), "Name: Åse&nbsp;&lt;  \x02 k! end", "", [{"v": ["Åse < k"]}]),
    ("decorated number", texts("u", clean=["numeric"], transform=["float"], aggregate="first"), "<u>€4,310.75</u>", "", [{"v": 4310.75}]),
    ("no number", texts("u", transform=["float"], aggregate="first"), "<u>sold out</u>", "", [{"v": None}]),
    ("null token", texts("u", clean=["null_tokens"], aggregate="first"), "<u>Unknown</u>", "", [{"v": None}]),
    ("a rule's own cleaning", one(sel("u", field("raw", attribute="k", clean=False), field("plain", attribute="k", clean=["fold"]))), "<u k=' ‘mist’ '>", "", [{"raw": [" ‘mist’ "], "plain": [" 'mist' "]}]),
    ("stages in one go", texts("u", clean=["entities", "invisibles", "whitespace", "fold"]), "<u>&lsquo;Low&#160;sun&rsquo;" + chr(0x200B) + "&nbsp; &mdash;\t now</u>", "", [{"v": ["'Low sun' - now"]}]),
    ("cleaning by name", texts("u", clean="whitespace"), "<u>m&nbsp; &amp;amp; n</u>", "", [{"v": ["m &amp; n"]}]),
    ("cleaning by number", texts("u", clean=0), "<u>m &amp;amp; n</u>", "", [{"v": ["m &amp; n"]}]),
    ("script in a text", texts("main"), "<main>m<script>k<\"/main></script>n<style>o</style></main>", "", [{"v": ["mn"]}]),
    ("a tag without end", texts("u"), "<u>m<b k='1>n</u>", "", [{"v": ["m"]}]),
    ("signs that are no markup", texts("u"), "<u>7 < 8 &nope; & &lt</u>", "", [{"v": ["7 < 8 &nope; & &lt"]}]),
    ("close without open", texts("u"), "</i><u>m</u></u>", "", [{"v": ["m"]}]),
    ("no fields", one({"selector": "u", "extract": []}), "<u>m</u>", "", [{}]),
]


@pytest.mark.parametrize("config,html,base,expected", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_records(spark, config, html, base, expected):
    assert extract(spark, config, html, base) == expected


@pytest.mark.parametrize("is_html", [False, True])
def test_bulk_text(spark, is_html):
    config = one({"regex": "WARN (.*)", "extract": [field()]})
    assert extract(spark, config, "WARN low \x07tide \nNOTE calm\n", "", is_html) == [{"v": ["low tide"]}]


def test_bulk_text_skips_selectors(spark):
    assert extract(spark, texts("u"), "<u>m</u>", is_html=False) == []


JOINS = [("?day=2", "https://sea.test/log/?day=2"), ("#noon", "https://sea.test/log/#noon"), ("old", "https://sea.test/log/old"), ("sms:77", "https://sea.test/log/sms:77"), ("tel:77", "tel:77"), ("data:,x", "data:,x"), ("./m", "https://sea.test/log/./m"), ("two words", "https://sea.test/log/two%20words"), ("/to?at=ftp://y", "/to?at=ftp://y"), ("", "https://sea.test/log/?day=1#dawn"), ("//cdn.test/n", "https://cdn.test/n"), ("/top", "https://sea.test/top")]


@pytest.mark.parametrize("base,rel,expected", [("https://sea.test/log/?day=1#dawn", *x) for x in JOINS] + [("", "m", "m"), ("https://sea.test", "m", "https://sea.test/m"), ("plain", "m", "m")])
def test_urljoin(spark, base, rel, expected):
    assert extract(spark, one(sel("a", field(attribute="href", clean=False, transform=["urljoin"], aggregate="first"), multiple=False)), f'<a href="{rel}">', base) == [{"v": expected}]


def columns(spark, values, build):

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_stages(spark):
    from pagequery.functions import sieve as S
    from pagequery.functions.entities import decode_clean, decode_leaf

    assert columns(spark, ["Tea &amp; oats &#8211; &#x5A;", "&amp;gt; &prod; &#0; & &;"], decode_clean) == ["Tea & oats – Z", "&gt; &prod; &#0; & &;"]
    assert columns(spark, ["&#133; &#0; &#x1F6A2; &prod; &sup2; &ouml;&zwnj;", "&#xDC00;|&#123456789012;"], decode_leaf) == ["… � 🚢 ∏ &sup2; ö" + chr(0x200C), "�|�"]
    assert columns(spark, ["no" + chr(0x200B) + "rt" + chr(0xFEFF) + "h\x06"], S.invisibles) == ["north"]
    assert columns(spark, ["\t m \n n" + chr(0x2003) + "o "], S.whitespace) == ["m n o"]
    assert columns(spark, ["‘ebb’ — “flow”…", "«m» ‹n›"], S.fold) == ["'ebb' - \"flow\"...", "\"m\" 'n'"]
    cases = {"€3,450.75": "3450.75", "-$7,000": "-7000", "about 2,300 rows": None, "98,7": None, "(4,100)": None, ".25": None, "8.": "8", "--3": "-3", "12 %": "12", "£ 6": "6", "+41": "41", "2,3456": None, "7 % %": None, "": None, "€ - 80": "-80"}
    assert columns(spark, list(cases), S.numeric) == [v if v is not None else k for k, v in cases.items()]
    assert columns(spark, ["na", "Nil", "--", "", "—", "UNKNOWN", "zero", "."], S.is_null_token) == [True] * 6 + [False] * 2


def test_references_by_hand(spark):
    """Random runs of parts of references, against one pass of a pattern."""
    import random

    from pagequery.functions.entities import LEAF, decode_leaf

    numbers = {"#65": "A", "#x41": "A", "#X041": "A", "#0": "\ufffd", "#133": "…"}
    draw = random.Random(5)
    parts = ["&", "&", "&", ";", ";", "#", "amp", "euro", "chi", "sup2", "x", "zz", "é", "\n", " ", "#65", "#x41", "#X041", "#0", "#133", "#6a", "#65\n"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(20_000)]

    def value(m):
        return numbers.get(m[1], m[0]) if m[1][0] == "#" else LEAF.get(m[1], m[0])

    expected = [re.sub("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", value, t) for t in texts]
    whole = [i for i, t in enumerate(texts) if not re.search("&#[xX]?[0-9a-fA-F]+;", t) or all(m in numbers for m in re.findall("&(#[xX]?[0-9a-fA-F]+);", t))]
    assert len(whole) > 15_000
    got = columns(spark, [texts[i] for i in whole], decode_leaf)
    assert got == [expected[i] for i in whole]


def test_every_character(spark):
    """White space and invisibles, for every character of the first plane, alone, doubled and beside a space."""
    from pagequery.functions import sieve as S

    blank = set(" \t\n\r\f\x0b") | {chr(c) for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}
    unseen = {chr(c) for c in [*range(9), 11, 12, *range(14, 32), *range(127, 160), 0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]}
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b{c}{c}c {c}d{c} e  f g{c}" for c in chars]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    out = rows.select("v", S.whitespace(F.col("v")).alias("w"), S.invisibles(F.col("v")).alias("i")).toPandas()
    runs = re.compile("[" + "".join(sorted(blank)) + "]+")
    assert out["w"].tolist() == [runs.sub(" ", t).strip(" ") for t in out["v"]]
    assert out["i"].tolist() == ["".join(x for x in t if x not in unseen) for t in out["v"]]


def test_numbers(spark):
    from pagequery.functions import transforms as T

    assert columns(spark, ["7days", "45.5", "3,200", "€3,200.40", "soon", " +9", "88888888888888888888", ""], T.to_int) == [7, 45, 3, 3200, None, 9, None, None]
    assert columns(spark, ["2.71828182", "0.0000004", "6e2", "2,300.25", "€2,300.25", "-.75k", "0x1F", "4e777", "k"], lambda c: T.six_decimals(T.to_float(c))) == ["2.718282", "0.000000", "600.000000", "2.000000", "2300.250000", "-0.750000", "31.000000", None, None]


def test_config_errors(spark):
    for bad in ({"queries": {"q": {"regex": "([unclosed", "extract": [field()]}}}, one(sel("p", field(text=True, clean=["does_not_exist"])))):
        with pytest.raises(ConfigError):
            extract(spark, bad, "<p>x</p>")
    for bad in ({"url": "u", "method": "INVALID", "queries": {"q": {"selector": "p"}}}, {"queries": {"q": {"selector": "p"}}}, {"url": "u", "queries": {"q": {"seletor": "p"}}}, {"url": "u"}, {"url": "u", "queries": {"q": {"selector": "p"}}, "output": {"format": "xml"}}):
        with pytest.raises(ConfigError):
            load_config(bad).validate()


def test_lenient_json():
    from pagequery.config import loads

    assert loads(r'{"m": "\w\.", "n": "C:\\k \"q\""}') == {"m": r"\w\.", "n": 'C:\\k "q"'}
    assert loads(r'["\uD83D\uDEA2", "\uDC00"]') == ["\U0001f6a2", "�"]
    assert loads("\t{}\n") == {}
    with pytest.raises(ConfigError):
        loads("{} {}")
    assert load_config(json.dumps({"url": "m", "queries": {}})) == Config.of({"url": "m", "queries": {}})


def test_clean_spec():
    from pagequery.config import clean_mask

    assert [clean_mask(x) for x in (True, False, 9, "ws", ["fold", "nulls"])] == [7, 0, 9, 4, 40]
    for bad in (3.5, ["fog"]):
        with pytest.raises(ConfigError):
            clean_mask(bad)


def test_lint():
    notes = load_config({"pagination": {"type": "next_link"}, "queries": {"q": sel("*", {"name": "x", "rule": {"selector": "a", "text": True, "transform": ["float", "first"]}})}}).lint()
    assert len(notes) == 4


def test_regex_dialect():
    from pagequery.functions.regex import groups, to_java

    assert to_java("m[[&&]n.") == r"m[\[&\&]n[^\n]" and to_java("<dd>(.*?)</dd>") == r"<dd>([^\n\r]*?)</dd>" and to_java("[^]k$") == r"[\s\S]k\z" and to_java("[]") == "(?!)"
    assert to_java(r"^\/\m[\b^]\v\0") == r"\A/m[\x08^]\x0B\x00"
    assert groups(r"(?:m)(n)[(]\(o(?=p)([)])") == 2
    for bad in ("[m", "m\\", "(?<k>m)"):
        with pytest.raises(ConfigError):
            to_java(bad)


REGEXES = [("at sea", "at sea, not at seat"), ("lang='([^']*)'", "lang='no' lang='' lang='nn'"), ("@([^|]*)\\|", "v@| w@key| u@@|"), ("k([^;])m", "kam k;m kbm"), ("no=([^&]{1,3})&", "no=7& no=7777& no=123&"), ("<dd>(.*?)</dd>", "<dd>1</dd><dd>2</dd> <dd></dd>"), ("<dt>(.*)</dt>", "<dt>1</dt><dt>2</dt>"), (r"([0-9]+\.[0-9]) kn", "4.5 kn, 7 kn, 12.0 kn"), ("depth ([0-9]+)", "depth 40 or depth 8"), ("([a-z]+)", "12 ab 3 c"), ("(?:bus|tram) ([0-9]+)", "bus 12, tram 7, car 3"), ("oo|o", "zoo o")]


def test_regex_against_python(spark):
    import random
    import re

    from pagequery.functions.regex import find_all

    rng = random.Random(23)
    hay = ["".join(rng.choice("km'|{}z- ") for _ in range(rng.randint(3, 30))) for _ in range(300)]
    for pattern in ("k([^']*)'", r"\{(.*?)\}", r"\{(.*)\}", r"m([^|]*)\|"):
        assert columns(spark, hay, lambda c, p=pattern: find_all(c, p)) == [re.findall(pattern, h) for h in hay]
    for pattern, text in REGEXES:
        assert columns(spark, [text], lambda c, p=pattern: find_all(c, p)) == [re.findall(pattern, text)]


def test_nulls_and_clashing_columns(spark):
    from pagequery import Engine

    df = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/", "<p>t</p>", "y")], "page_id long, url string, html string, _pos string")
    rows = Engine(texts("p")).table(df).collect()
    assert [(r["page_id"], r["v"]) for r in rows] == [(2, ["t"])]


def test_index_invariants():
    import random

    from pagequery.operators.index import elements

    rng = random.Random(3)
    parts = ["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<br>", "text", "<!-- x -->", "<b x='>'>", "</b>", "<script>if(a<b)</script>", "<", "<td>", "<h1>", "<i/>", "&amp;"]
    for _ in range(300):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        found = elements(html)
        ends = [(e.close, e.open) for e in found]
        assert all(a.close <= b.close or b.tag in ("br", "i", "script") for a, b in zip(found, found[1:])), (html, ends)
        for a in found:
            assert html[a.open] == "<" and a.open < a.open_gt < a.inner <= a.close <= a.end <= len(html) or a.close == a.inner
            for b in found:
                assert a is b or a.end <= b.open or b.end <= a.open or (a.open <= b.open and b.close <= a.close) or (b.open <= a.open and a.close <= b.close)


def test_one_close_at_once_is_like_two_steps():
    """An element with text alone inside is matched whole; cutting the match apart by a comment changes no element but its offsets."""
    import random

    from pagequery.operators.index import elements

    rng = random.Random(31)
    parts = ["<p>m</p>", "<li>n</li>", "<b>o</b>", "<br>p</br>", "<div>", "</div>", "<td>q</td>", "<script>r</script>", "<i/>s</i>", "<P>t</p>", "text", "</b>"]
    for _ in range(500):
        pieces = [rng.choice(parts) for _ in range(rng.randint(1, 12))]
        whole = "".join(pieces)
        cut = "".join(x.replace("</", "<!----></", 1) if not x.startswith(("</", "<script")) else x for x in pieces)
        assert [(e.tag, e.seq) for e in elements(whole)] == [(e.tag, e.seq) for e in elements(cut)], whole


def test_names_of_keys(spark):
    """A field that bears a key's name takes its place."""
    from pagequery import Engine

    df = spark.createDataFrame([(1, "http://sea.test/", "<u k=m>n</u>")], "page_id long, url string, html string")
    config = {"queries": {"q": sel("u", field("page_id", attribute="k"), field("url", text=True), field("_pos", attribute="k", aggregate=None))}}
    out = Engine(config, keys=("page_id", "url")).table(df)
    assert out.columns == ["page_id", "url", "_pos"] and tuple(out.first()) == (["m"], ["n"], ["m"])
    both = Engine(config, keys=("page_id", "url")).records(df).first().asDict()
    assert both["page_id"] == ["m"] and both["_query"] == 0


def test_one_index_pass(spark):
    from pagequery import Engine

    df = spark.createDataFrame([(1, "http://sea.test/", "<u>m</u><b>n</b><i>o</i>")], "page_id long, url string, html string")
    queries = {k: sel(k, field("t", text=True)) for k in ("u", "b", "i")} | {"z": sel("u", field("n", aggregate="count")), "r": {"regex": ">([a-z])<", "extract": [field("t")]}}
    out = Engine({"queries": queries}).records(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = [(r["_name"], r["_pos"], r["t"], r["n"]) for r in out.orderBy("_query", "_pos").collect()]
    assert rows == [("b", 0, ["n"], None), ("i", 0, ["o"], None), ("r", 0, ["m"], None), ("r", 1, ["n"], None), ("r", 2, ["o"], None), ("u", 0, ["m"], None), ("z", 0, None, 1)]
    config = Engine({"queries": queries})
    for name in queries:
        alone = [r["t"] for r in config.table(df, name).orderBy("_pos").collect()] if name != "z" else [None]
        assert alone == [t for n, _, t, _ in rows if n == name]
