import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitgraph.extract import java, javascript, jsp, registry, xmlunits
from unitgraph.extract.lexer import lex
from unitgraph.queries import sources as S


def by_name(units):
    return {u["qualified_name"]: u for u in units}


def test_java_class():
    units = java.parse(S.JAVA_A)
    assert [u["qualified_name"] for u in units] == ["com.acme.shop.Cart#Cart", "com.acme.shop.Cart#addItem", "com.acme.shop.Cart#addItem", "com.acme.shop.Cart#isSorted", "com.acme.shop.Cart.Line#getText", "com.acme.shop.Cart.Line.Kind#rank", "com.acme.shop.Priced#price"]
    ctor, add, short, generic, *_ = units
    assert ctor["unit_type"] == "constructor" and ctor["body_text"].startswith("{ this.items")
    assert add["comment"] == "Adds an item to the cart." and add["signature"] == "@Override public synchronized boolean addItem(final String name, int... counts)"
    assert (add["param_names"], add["param_types"], add["start_line"], add["end_line"]) == (["name", "counts"], ["String", "int"], 17, 21)
    assert [(c["name"], c["line"]) for c in add["calls"]] == [("check", 19), ("check", 20), ("add", 20), ("trim", 20), ("toLowerCase", 20)]
    assert add["summary"].startswith("[Java] class Cart method add Item | full: Cart.addItem(final String name, int... counts) | param types: String int | returns: boolean | doc: Adds an item")
    assert [c["name"] for c in generic["calls"]] == ["run"] and generic["return_type"] == "java.util.Map<String, T>" and "boolean check: is Sorted" in generic["summary"]


def test_java_array_and_recovery():
    (unit,) = java.parse(S.JAVA_B)
    assert (unit["start_line"], unit["end_line"]) == (6, 6) and "validation: validate All" in unit["summary"]
    saved, after = java.parse(S.JAVA_BROKEN)
    assert saved["qualified_name"] == "p.Broken#saveOrder" and saved["comment"] == "Saves it." and after["name"] == "after"


def test_javascript():
    units = by_name(javascript.parse(S.JS))
    assert list(units) == ["load", "Cart.constructor", "Cart.isEmpty", "total.total", "twice.twice", "load_L8", "named.named"]
    assert units["load"]["param_names"] == ["a", "b", "rest"] and units["load"]["comment"] == "top"
    assert [c["name"] for c in units["load"]["calls"]] == ["fetch", "fetch(a).then", "api.v1.get"]
    assert units["twice.twice"]["body_text"] == "" and units["total.total"]["class_name"] == "total"


def test_jsp():
    units = jsp.parse(S.JSP)
    assert [u["qualified_name"] for u in units] == ["decl_twice_3", "scriptlet_0_3", "scriptlet_2_89"]
    assert units[0]["body_text"].endswith("return 0; }") and units[1]["end_line"] == 7
    assert "hidden" not in " ".join(u["body_text"] for u in units)
    kinds = [u["unit_type"] for u in jsp.parse(S.JSP, with_tags=True)]
    assert kinds.count("custom_tag") == 2 and kinds.count("el_expression") == 1
    assert [u["qualified_name"] for u in jsp.numbered([{"qualified_name": n} for n in "aaba"])] == ["a", "a_1", "b", "a_2"]


def test_xml():
    assert [u["unit_type"] for u in xmlunits.parse(S.MAPPER.encode())] == ["mybatis_sql_fragment", "mybatis_select", "mybatis_delete"]
    assert xmlunits.parse(S.MAPPER.encode())[1]["summary"] == "[XML/MyBatis] SELECT find | param: long | result: cart | sql: SELECT  FROM cart id = #{id}"
    beans = xmlunits.parse(S.BEANS.encode())
    assert [u["qualified_name"] for u in beans] == ["component-scan.com.acme", "bean.cart", "bean.store"] and beans[1]["calls"] == [{"name": "store", "line": 3}]
    assert [u["signature"] for u in xmlunits.parse(S.POM.encode())] == ["com.acme:shop:1.0", "org.x:y:2"]
    assert [u["body_text"] for u in xmlunits.parse(S.WEB.encode())] == ["com.acme.Front", "com.acme.Log"]
    assert len(xmlunits.parse(S.GENERIC.encode())) == 100 and xmlunits.parse(b"") == []


@pytest.mark.parametrize(
    "broken, names",
    [
        ("<mapper namespace='m'>\n<select id='a'>x < 1 & y</select>\n<delete id=b>d</delete></mapper>", [("m.a", 2), ("m.b", 3)]),
        ("<mapper namespace='m'><select id='a'><if>x</select>\n<update id='b'>u</update>", [("m.a", 1), ("m.b", 2)]),
        ("<mapper namespace='m'></where><q:select id='a' id='z'>x</q:select>\n</mapper>\n<mapper/>", [("m.a", 1)]),
        ("<?xml version='1.0' encoding='no-such'?>\n<mapper namespace='m'><select\n id='a'>&nbsp;</select></wrong><insert id='b'/></mapper>", [("m.a", 2), ("m.b", 3)]),
    ],
)
def test_xml_goes_on_after_a_fault(broken, names):
    assert [(u["qualified_name"], u["start_line"]) for u in xmlunits.parse(broken.encode())] == names


@given(st.text(alphabet="<>/&;=\"' ab:!-[]?x\n", max_size=80))
@settings(max_examples=500, deadline=None)
def test_repaired_xml_is_well_formed(text):
    fixed = xmlunits.repaired("<r>" + text)
    assert xmlunits._parsed(fixed.encode())[2] or "<!" in text or "<?" in text or ":" in text or "]]>" in text


def test_encodings():
    assert {n: registry.encoding_of(b) for n, b in S.ENCODED.items()} == {"utf8": "utf-8", "shift_jis": "cp932", "gbk": "gb2312", "latin": "cp1252", "undefined": "cp932"}


@given(st.text(alphabet="ab(){};=>,.\"'/*\n @classfunction#int", max_size=120))
@settings(max_examples=300, deadline=None)
def test_extractors_take_anything(text):
    for parse in (java.parse, javascript.parse, jsp.parse):
        for u in parse(text):
            assert u["start_line"] >= 1
    xmlunits.parse(text.encode())
    assert "".join(t.text for t in lex(text)).replace(" ", "") == re.sub(r"\s", "", text) or "\"" in text or "'" in text or "/" in text


def test_extract_frame(spark):
    files = S.files(spark, "java").union(spark.createDataFrame([(1, "x.foo", "foo", bytearray(b"x")), (1, "bad.zig", "zig", bytearray(b"x"))], "repo_id bigint, file_path string, language string, content binary"))

    def fail(raw, settings):
        raise ValueError("no")

    registry.register_extractor("zig", fail)
    try:
        out = registry.extract(files).cache()
    finally:
        registry._EXTRACTORS.pop("zig")
    assert [(r.file_path, r.error) for r in registry.rejects(out).collect()] == [("bad.zig", "ValueError: no")]
    assert registry.units(out).count() == 10
    edges = {(r.caller.split("#")[1], r.callee): r.call_line for r in registry.edges(out).where("file_path = 'A.java'").collect()}
    assert edges["addItem", "check"] == 19
    with pytest.raises(Exception):
        registry.encoding_of(None)
