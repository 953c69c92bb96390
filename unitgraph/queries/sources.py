"""Small hand-written sources that the extractor queries and tests read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JAVA_A = '''package com.acme.shop;

import java.util.List;

/**
 * A cart.
 */
public class Cart {
    private final List<String> items = build(1);

    public Cart(int size) { this.items.clear(); reset(size); }

    /**
     * Adds an item
     * to the cart.
     */
    @Override
    public synchronized boolean addItem(final String name, int... counts) {
        check(name);
        check(name); return items.add(name.trim().toLowerCase());
    }

    public boolean addItem(String name) { return addItem(name, 1); }

    <T extends Comparable<T>> java.util.Map<String, T> isSorted(List<T> all, @Nullable int[] marks) throws java.io.IOException {
        String s = "not a call(x) {";
        return new Sorter(all).run();
    }

    static class Line {
        String getText() { return text; }
        enum Kind { A("x(1)"), B { int f() { return 1; } }; int rank() { return rank0(); } }
    }
}

interface Priced { long price(String sku); }

record Point(int x, int y) { int sum() { return x + y; } }
'''
JAVA_B = '''class Table {
    private static final char[][] DATA = {
        {'a', '}'.length()},
        {'b'}
    };
    public void validateAll(int a) { if (a > 0) { run(a); } }
}
'''
JAVA_BROKEN = '''package p;
class Broken {
    /** Saves it. */
    public int saveOrder(String id) { if (id != null) { return store(id, 2); }
    private void after(int n) { log(n); flush(); }
'''
JS = '''// top
function load(a, b = 2, ...rest) { fetch(a).then(done); api.v1.get(b); }
class Cart {
  constructor(x) { this.x = x; }
  async isEmpty() { return this.items.size(/[)(]/.test(s)); }
}
const total = (items, f) => { return sum(items) / f(1); };
const twice = x => double(x);
function load() {}
let named = function inner(q) { return q; };
'''
JSP = '''<%-- hidden <% int x = 1; %> --%>
<%@ page import="java.util.*" %>
<%! private int twice(int n) { if (n > 0) { return 2 * n; } return 0; } %>
<p><%= twice(2) %></p>
<% int a = 1;
   int b = 2; %>
<% int c = 3; %>
''' + "\n" * 40 + '''<% short(); %>
''' + "\n" * 40 + '''<%
  for (int i = 0; i < 3; i++) {
    out.print(i);
  }
%>
<c:if test="${cart.empty}" id='x'><fmt:message key="k"/></c:if>${cart.empty}
'''
MAPPER = '''<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x//DTD Mapper 3.0//EN" "http://x/mapper.dtd">
<mapper namespace="com.acme.CartMapper">
  <sql id="cols">id, name</sql>
  <select id="find" parameterType="long" resultMap="cart">SELECT <include refid="cols"/> FROM cart <where><if test="id != null">id = #{id}</if></where></select>
  <delete id="drop">DELETE FROM cart</delete>
</mapper>
'''
BEANS = '''<beans xmlns="http://www.springframework.org/schema/beans" xmlns:context="http://www.springframework.org/schema/context">
  <context:component-scan base-package="com.acme"/>
  <bean id="cart" class="com.acme.Cart"><property name="store" ref="store"/><property name="n" value="1"/></bean>
  <bean name="store" class="com.acme.Store" scope="prototype"/>
</beans>
'''
POM = '''<project xmlns="http://maven.apache.org/POM/4.0.0">
  <groupId>com.acme</groupId><artifactId>shop</artifactId><version>1.0</version>
  <dependencies><dependency><groupId>org.x</groupId><artifactId>y</artifactId><version>2</version></dependency><dependency><groupId>broken</groupId></dependency></dependencies>
</project>
'''
WEB = '''<web-app xmlns="https://jakarta.ee/xml/ns/jakartaee">
  <servlet><servlet-name>front</servlet-name><servlet-class>com.acme.Front</servlet-class></servlet>
  <filter><filter-name>log</filter-name><filter-class>com.acme.Log</filter-class></filter>
</web-app>
'''
GENERIC = "<settings>" + "".join(f"<item>value {i}</item>" for i in range(130)) + "<open>"

SOURCES = {
    "java": {"A.java": JAVA_A, "B.java": JAVA_B, "Broken.java": JAVA_BROKEN},
    "javascript": {"cart.js": JS},
    "jsp": {"cart.jsp": JSP},
    "xml": {"mapper.xml": MAPPER, "beans.xml": BEANS, "pom.xml": POM, "web.xml": WEB, "generic.xml": GENERIC},
}
ENCODED = {
    "utf8": "class 店 {}".encode(),
    "shift_jis": "class 店 { void 表示() {} }".encode("cp932"),
    "gbk": "class 购物车 { void 显示() {} }".encode("gb2312"),
    "latin": b"caf\xe9 \xff",
    "undefined": b"\x81\x8d \xff",
}


def files(spark: SparkSession, language: str) -> DataFrame:
    rows = [(1, name, language, bytearray(text.encode())) for name, text in SOURCES[language].items()]
    return spark.createDataFrame(rows, "repo_id bigint, file_path string, language string, content binary")
