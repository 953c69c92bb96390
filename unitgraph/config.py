"""Settings: one frozen object that operators take; the defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass, field

# File types, folders and names that a scan knows.
LANGUAGES = {".java": "java", ".jsp": "jsp", ".js": "javascript", ".xml": "xml"}
SKIP_DIRS = (
    ".git", "node_modules", "target", "build", ".idea", "__pycache__",
    "dist", "vendor", "vendors", "lib", "libs", "third_party", "thirdparty",
    "third-party", "bower_components", "webjars", ".mvn", ".gradle",
)
SKIP_FRAGMENTS = (
    "static/plugins", "static/lib", "static/libs", "static/js/plugins", "webapp/static", "WebContent/static",
    "resources/static/js", "resources/static/lib", "public/vendor", "assets/vendor", "assets/lib",
    "webjars", "META-INF/resources",
)
SKIP_NAMES = (
    "jquery", "bootstrap", "angular", "react", "vue", "lodash", "underscore",
    "backbone", "ember", "knockout", "zepto", "prototype", "mootools",
    "axios", "moment", "dayjs", "echarts", "highcharts", "d3", "chart.js",
    "three.js", "raphael", "snap", "fabric", "paper", "p5",
    "popper", "tippy", "toastr", "sweetalert", "layer", "layui",
    "datatables", "select2", "chosen", "fullcalendar", "flatpickr",
    "quill", "tinymce", "ckeditor", "codemirror", "ace",
    "font-awesome", "fontawesome", "iconfont",
    "socket.io", "sockjs", "stomp", "mqtt",
    "crypto-js", "jsencrypt", "forge",
    "require.js", "requirejs", "seajs", "systemjs",
    "webpack", "rollup", "vite", "gulp", "grunt",
    "normalize", "reset", "animate",
    ".min.", "-min.", ".bundle.", ".pack.",
    "generated-sources", "generated_sources",
    "spring-beans", "spring-context", "mybatis-config",
    "web-fragment", "persistence",
)
WATCH_SKIP_DIRS = (".git", "target", "build", "__pycache__", "node_modules", "dist", ".idea", ".vscode", "db")
#: Method names too general to be matched without their class.
GENERAL_NAMES = (
    "get", "set", "run", "call", "find", "save", "load", "send",
    "init", "start", "stop", "close", "open", "read", "write",
    "add", "put", "remove", "clear", "reset", "update", "create",
    "check", "is", "has", "log", "print", "format", "parse",
    "execute", "handle", "process", "build", "make", "convert",
)
#: Terms of a query and the names they may go by in code.
TERMS = {
    "判空": ["empty", "null", "blank", "isEmpty", "isNull", "isBlank"],
    "为空": ["empty", "null", "isEmpty", "isNull"],
    "非空": ["notEmpty", "notNull", "isNotEmpty", "isNotNull"],
    "空": ["empty", "null", "isEmpty"],
    "ヌル": ["null", "isNull"],
    "空チェック": ["isEmpty", "isNull", "isBlank"],
    "数组": ["Array", "isArray"],
    "配列": ["Array", "isArray"],
    "集合": ["Collection", "List", "Set"],
    "リスト": ["List", "ArrayList"],
    "对象": ["Object", "isNull", "isNotNull"],
    "オブジェクト": ["Object", "isNull"],
    "字符串": ["String", "StringUtils", "str"],
    "文字列": ["String", "StringUtils"],
    "判断": ["check", "is", "validate", "verify"],
    "チェック": ["check", "validate", "verify"],
    "検証": ["validate", "verify"],
    "校验": ["validate", "verify", "check"],
    "验证": ["validate", "verify"],
    "查询": ["query", "select", "find", "search", "get"],
    "検索": ["search", "find", "query"],
    "保存": ["save", "insert", "add"],
    "削除": ["delete", "remove"],
    "删除": ["delete", "remove", "clear"],
    "更新": ["update", "modify", "set"],
    "获取": ["get", "fetch", "find"],
    "取得": ["get", "fetch"],
    "格式化": ["format", "formatter"],
    "转换": ["convert", "parse", "cast"],
    "変換": ["convert", "parse"],
    "加密": ["encrypt", "encode", "hash"],
    "解密": ["decrypt", "decode"],
    "日期": ["date", "Date", "time"],
    "日付": ["date", "Date"],
    "时间": ["time", "timestamp", "Date"],
    "缓存": ["cache", "Cache"],
    "キャッシュ": ["cache", "Cache"],
    "日志": ["log", "logger"],
    "ログ": ["log", "logger"],
    "权限": ["permission", "auth", "role"],
    "権限": ["permission", "auth", "role"],
    "用户": ["user", "User"],
    "ユーザー": ["user", "User"],
    "分页": ["page", "pagination"],
    "文件": ["file", "File"],
    "ファイル": ["file", "File"],
    "异常": ["exception", "error", "Exception"],
    "例外": ["exception", "error"],
    "请求": ["request", "Request"],
    "响应": ["response", "Response"],
}


@dataclass(frozen=True)
class Settings:
    max_depth: int = 3
    max_nodes: int = 200
    short_name_length: int = 4
    general_names: tuple[str, ...] = GENERAL_NAMES
    rrf_k: int = 60
    candidates: int = 20
    fetch: int = 60  # of each collection: three times the candidates, 20 at least
    rerank_top: int = 5
    keyword_limit: int = 15
    scriptlet_gap: int = 30
    scriptlet_lines: int = 3
    debounce_ms: int = 1500
    body_chars: int = 2000
    sql_chars: int = 3000
    diff_chars: int = 3000
    leaf_limit: int = 100
    indirect_limit: int = 8
    min_body_lines: int = 2
    max_script_bytes: int = 500 * 1024
    max_java_bytes: int = 5 * 1024 * 1024
    accessor_prefixes: tuple[str, ...] = field(default=("get", "set", "is", "has", "with", "to"))


DEFAULT = Settings()
