"""XML units by the kind of the root: mapper, beans, project, web application, anything else (SC7, EX20-EX25)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

from ..config import DEFAULT, Settings
from .lexer import unit


@dataclass
class Node:
    tag: str  # local name
    space: str
    attrs: dict[str, str]
    line: int
    parts: list = field(default_factory=list)  # strings and nodes, in order

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    @property
    def text(self) -> str:
        """Text before the first child."""
        out = []
        for p in self.parts:
            if isinstance(p, Node):
                break
            out.append(p)
        return "".join(out)

    def everything(self) -> str:
        return "".join(p.everything() if isinstance(p, Node) else p for p in self.parts)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def find(self, tag: str) -> Node | None:
        return next((c for c in self.children if c.tag == tag), None)

    def value(self, tag: str, other: str = "") -> str:
        child = self.find(tag)
        return child.text.strip() or other if child is not None else other


_MARKUP = re.compile(
    r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>
    |<(?P<end>/?)(?P<name>[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*?)(?P<empty>/?)>""",
    re.S | re.X,
)
_VALUE = re.compile(r"""([A-Za-z_][\w:.\-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BARE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)")


def repaired(text: str) -> str:
    """A broken document made well-formed, line for line.

    Signs that begin no markup become text, attributes get quotes and are kept once, prefixes
    that nothing declares are dropped, an end tag closes what is open inside its element, and one
    without a start tag is left out; what is open at the end is closed.
    """
    declared = {"xml", "xmlns", *re.findall(r"xmlns:([\w.\-]+)\s*=", text)}
    escaped = lambda raw: _BARE.sub("&amp;", raw).replace("<", "&lt;")
    local = lambda name: name if name.partition(":")[0] in declared or ":" not in name else name.partition(":")[2]
    out, opened, at, rooted = [], [], 0, False
    for m in _MARKUP.finditer(text):
        between, at = text[at : m.start()], m.end()
        out.append(escaped(between) if opened else "\n" * between.count("\n"))
        if not m["name"]:
            out.append(m[0] if opened or not rooted and m[0][1] in "!?" and not m[0].startswith("<![") else "")
            continue
        name = local(m["name"])
        if m["end"]:
            while name in opened:
                out.append(f"</{opened[-1]}>")
                if opened.pop() == name:
                    break
            continue
        if rooted and not opened:  # a second root
            break
        rooted = True
        attrs: dict[str, str] = {}
        for key, *values in _VALUE.findall(m["attrs"]):
            attrs.setdefault(local(key), escaped("".join(values)).replace('"', "&quot;"))
        lines = m[0].count("\n") - sum(v.count("\n") for v in attrs.values())
        out.append(f"<{name}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + "\n" * max(0, lines) + ("/>" if m["empty"] else ">"))
        if not m["empty"]:
            opened.append(name)
    if opened:
        out.append(escaped(text[at:]))
    return "".join(out) + "".join(f"</{name}>" for name in reversed(opened))


def tree(data: bytes) -> tuple[Node | None, set[str]]:
    """Root and namespaces; a broken document is read as :func:`repaired`, or up to its first fault if that can't be read either."""
    root, spaces, whole = _parsed(data)
    if whole:
        return root, spaces
    named = re.search(rb"<\?xml[^>]*encoding=[\"']([\w.\-]+)", data[:200])
    try:
        text = data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        text = data.decode("utf-8", "replace")
    again, more, whole = _parsed(re.sub(r"(<\?xml[^>]*?)\s+encoding=[\"'][^\"']*[\"']", r"\1", repaired(text), count=1).encode())
    return (again, more) if whole else (root, spaces)


def _parsed(data: bytes) -> tuple[Node | None, set[str], bool]:
    """Root, namespaces, and whether the document was read to its end."""
    parser = expat.ParserCreate(namespace_separator="\x01")
    stack: list[Node] = []
    root: list[Node] = []
    spaces: set[str] = set()

    def start(name, attrs):
        space, _, tag = name.rpartition("\x01")
        node = Node(tag, space, {k.rpartition("\x01")[2]: v for k, v in attrs.items()}, parser.CurrentLineNumber)
        (stack[-1].parts if stack else root).append(node)
        stack.append(node)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: stack.pop()
    parser.CharacterDataHandler = lambda text: stack and stack[-1].parts.append(text)
    parser.StartNamespaceDeclHandler = lambda prefix, uri: spaces.add(uri or "")
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, LookupError, ValueError):
        return (root[0] if root else None), spaces, False
    return (root[0] if root else None), spaces, True


def kind(root: Node, spaces: set[str]) -> str:
    """What the file is, by the root's local name (EX20, Q24)."""
    tag = root.tag.lower()
    if "mapper" in tag:
        return "mybatis"
    if tag in ("beans", "applicationcontext") or any("springframework" in s for s in spaces):
        return "spring"
    if tag == "project" and root.find("groupId") is not None:
        return "maven"
    if tag == "web-app":
        return "web"
    return "config" if "configuration" in tag else "generic"


def _unit(node: Node, **fields) -> dict:
    return unit(language="xml", start_line=node.line, end_line=node.line, **fields)


def _mybatis(root: Node, settings: Settings) -> list[dict]:
    out, space = [], root.attrs.get("namespace", "")
    for node in root.children:
        tag = node.tag.lower()
        if tag not in ("select", "insert", "update", "delete", "sql"):
            continue
        name = node.attrs.get("id", "unknown")
        full = f"{space}.{name}" if space else name
        sql = node.everything().strip()[: settings.sql_chars]
        takes, gives = node.attrs.get("parameterType", ""), node.attrs.get("resultType", node.attrs.get("resultMap", ""))
        parts = [f"[XML/MyBatis] {tag.upper()} {name}", takes and f"param: {takes}", gives and f"result: {gives}", sql and f"sql: {sql[:60]}"]
        out.append(_unit(node, unit_type="mybatis_sql_fragment" if tag == "sql" else f"mybatis_{tag}", qualified_name=full, name=name, signature=f"{tag.upper()} {full}", body_text=sql, summary=" | ".join(p for p in parts if p)))
    return out


def _spring(root: Node, settings: Settings) -> list[dict]:
    out = []
    for node in root.walk():
        tag = node.tag.lower()
        if tag == "bean":
            name, cls = node.attrs.get("id") or node.attrs.get("name", "anonymous"), node.attrs.get("class", "")
            refs = [(c.attrs["ref"], c.line) for c in node.children if c.tag == "property" and c.attrs.get("ref")]
            text = f"[XML/Spring] bean: {name} | class: {cls} | scope: {node.attrs.get('scope', 'singleton')}"
            if refs:
                text += " | refs: " + ", ".join(r for r, _ in refs[:4])
            out.append(_unit(node, unit_type="spring_bean", qualified_name=f"bean.{name}", name=name, signature=f"<bean id='{name}' class='{cls}'>", body_text=cls, calls=[{"name": r, "line": n} for r, n in refs], summary=text))
        elif tag == "component-scan" and node.attrs.get("base-package"):
            base = node.attrs["base-package"]
            out.append(_unit(node, unit_type="spring_component_scan", qualified_name=f"component-scan.{base}", name=base, signature=f"<context:component-scan base-package='{base}'>", body_text=base, summary=f"[XML/Spring] component-scan: {base}"))
    return out


def _maven(root: Node, settings: Settings) -> list[dict]:
    out = []
    group, artifact, version = (root.value(t) for t in ("groupId", "artifactId", "version"))
    if artifact:
        own = f"{group}:{artifact}:{version}"
        out.append(_unit(root, unit_type="pom_module", qualified_name=f"{group}.{artifact}", name=artifact, signature=own, body_text=own, summary=f"[XML/Maven] module: {artifact} | group: {group} | version: {version}"))
    listed = root.find("dependencies")
    for node in listed.children if listed is not None else []:
        if node.find("groupId") is None or node.find("artifactId") is None:
            continue
        g, a, v = (node.value(t) for t in ("groupId", "artifactId", "version"))
        out.append(_unit(node, unit_type="pom_dependency", qualified_name=f"dep.{g}.{a}", name=a, signature=f"{g}:{a}:{v}", body_text=f"{g}:{a}:{v}", summary=f"[XML/Maven] dependency: {g}:{a}:{v}"))
    return out


def _web(root: Node, settings: Settings) -> list[dict]:
    out = []
    for what in ("servlet", "filter"):
        for node in root.walk():
            if node.tag == what:
                name, cls = node.value(f"{what}-name", "unknown"), node.value(f"{what}-class")
                out.append(_unit(node, unit_type=f"web_{what}", qualified_name=f"{what}.{name}", name=name, signature=f"<{what}-name>{name}</{what}-name>", body_text=cls, summary=f"[XML/web.xml] {what}: {name} | class: {cls}"))
    return out


def _generic(root: Node, settings: Settings) -> list[dict]:
    """Leaves with text, the first hundred; numbered by their place among all elements (EX25, W5)."""
    out = []
    for i, node in enumerate(root.walk()):
        if not node.children and node.text.strip():
            value = node.text.strip()[: settings.body_chars]
            out.append(_unit(node, unit_type="xml_element", qualified_name=f"{node.tag}_{i}", name=node.tag, signature=f"<{node.tag}>", body_text=value, summary=f"[XML] <{node.tag}>: {value[:80]}"))
    return out[: settings.leaf_limit]


def parse(data: bytes, settings: Settings = DEFAULT) -> list[dict]:
    root, spaces = tree(data)
    if root is None:
        return []
    readers = {"mybatis": _mybatis, "spring": _spring, "maven": _maven, "web": _web}
    return readers.get(kind(root, spaces), _generic)(root, settings)
