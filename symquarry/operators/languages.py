"""The grammars of all supported files, and which file is read by which.

Patterns, kinds and file names below are fixed values: results have to agree on them. Word boundaries and
character classes are ASCII, as the engine compiles them.
"""

from __future__ import annotations

import re

from .grammar import (
    SPACES,
    Grammar,
    Line,
    Rule,
    Scope,
    Walk,
    cut_at,
    hash_outside_quotes,
    parameters,
    percent_outside_quotes,
    php_comment,
    slashes_outside_escaped,
    slashes_outside_quotes,
    slashes_outside_strings,
    split_lines,
    squeeze,
)

ID = "[A-Za-z_][A-Za-z0-9_]*"
JS_ID = "[A-Za-z_$][A-Za-z0-9_$]*"


def never(text: str) -> bool:
    return False


def hash_or_blank(text: str) -> bool:
    return not text or text[0] == "#"


def file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def stem(path: str) -> str:
    name = file_name(path)
    return name[: name.rindex(".")] if "." in name[1:] else name


def attribute(text: str, name: str, spaced: bool = False) -> str:
    """Value of the first attribute whose name ends like this."""
    for mark in (name + "=", name + " =") if spaced else (name + "=",):
        at = text.find(mark)
        if at >= 0:
            m = re.compile("""[^"']*(["'])(.*?)\\1""", re.S).match(text, at + len(name))
            return m.group(2) if m else ""
    return ""


def remember(key: str, group: int = 1):
    def act(walk: Walk, m: re.Match, index: int = -1) -> None:
        walk.vars[key] = m.group(group)

    return act


def flag(key: str, value=True):
    def act(walk: Walk, m: re.Match) -> None:
        walk.vars[key] = value

    return act


def has(key: str):
    return lambda walk: bool(walk.vars.get(key))


def enter_section(walk: Walk, m: re.Match, index: int) -> None:
    walk.vars["section"], walk.vars["section_symbol"] = walk.symbols[index]["name"], index


def in_type(walk: Walk) -> bool:
    return walk.type is not None


TAG = r"^[^<]*<(?![/!?])([^ \t\n\v\f\r>/]+)"

# ---- shells

SHELL_WORDS = ("if", "then", "fi", "for", "do", "done", "case", "esac")
SHELL = Grammar(
    "shell",
    [
        Rule("shell_function", rf"^\s*(?:function\s+)?({ID})\s*(?:\(\))?\s*\{{"),
        Rule("shell_export", rf"^\s*export\s+({ID})=?"),
        Rule("shell_alias", r"^\s*alias\s+([A-Za-z_][A-Za-z0-9_\-]*)="),
        Rule("shell_source", r"^\s*(?:source|\.)\s+(.+)", name=lambda w, m: m.group(1).strip(SPACES)),
        Rule("shell_command", r"^\s*([A-Za-z_][A-Za-z0-9_\-\.]*)\b", name=lambda w, m: "" if m.group(1) in SHELL_WORDS else m.group(1)),
    ],
    strip=hash_outside_quotes,
    skip=lambda t: not t or t.startswith("#!"),
)
POWERSHELL = Grammar(
    "powershell",
    [
        Rule("powershell_function", r"^\s*function\s+([A-Za-z_][A-Za-z0-9_\-]*)\b"),
        Rule("powershell_param_block", r"^\s*param\s*\(", name="param"),
        Rule("powershell_variable", rf"^\s*(?:\[[^\]]+\]\s*)?\$({ID})\s*=", name="${1}"),
        Rule("powershell_alias", r"^\s*(?:Set-Alias|New-Alias)\s+(?:-Name\s+)?([A-Za-z_][A-Za-z0-9_\-]*)"),
        Rule("powershell_manifest_property", r"^\s*(RootModule|ModuleVersion|GUID|Author|FunctionsToExport|CmdletsToExport)\s*="),
        Rule("powershell_command", rf"^\s*({ID}-{ID})\b"),
    ],
    strip=hash_outside_quotes,
)

# ---- SQL


def clean_sql(name: str) -> str:
    return name.strip(SPACES).lstrip('"[`').rstrip('"]`;(')


def migration(walk: Walk) -> None:
    if "migration" in walk.path.lower():
        walk.code = walk.path
        name = file_name(walk.path).lower()
        walk.emit("sql_migration", clean_sql(name), line=0, find=name)


SQL = Grammar(
    "sql",
    [
        Rule(
            lambda w, m: "sql_" + {"proc": "procedure"}.get(m.group(1).lower(), m.group(1).lower()),
            r"""^\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|ALTER\s+|DROP\s+)?(TABLE|VIEW|INDEX|PROCEDURE|PROC|FUNCTION|TRIGGER|SCHEMA)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([A-Za-z0-9_\.\[\]`"]+)""",
            name=lambda w, m: clean_sql(m.group(2)),
            extra=lambda w, m: {"find": m.group(2)},
            flags=re.I,
        )
    ],
    strip=cut_at("--"),
    skip=never,
    squeezes=False,
    start=migration,
)

# ---- deployment files

DOCKER = Grammar(
    "dockerfile",
    [
        Rule(
            lambda w, m: "docker_" + m.group(1).lower(),
            r"^\s*(FROM|RUN|COPY|ADD|CMD|ENTRYPOINT|ARG|ENV|EXPOSE|WORKDIR)\s+(.+)",
            name=lambda w, m: m.group(2).strip(SPACES),
            on="line",
            flags=re.I,
        )
    ],
    skip=never,
    squeezes=False,
)
YAML_SECTIONS = ("services", "volumes", "networks", "jobs", "steps")


def yaml_kind(walk: Walk, m: re.Match) -> str:
    if m.group(1) in YAML_SECTIONS:
        walk.vars["part"] = m.group(1)
        return "yaml_section"
    return "compose_service" if walk.vars.get("part") == "services" else "yaml_property"


YAML = Grammar("yaml", [Rule(yaml_kind, r"^\s*([A-Za-z0-9_.\-]+):\s*(.*)", on="line")], skip=never, squeezes=False)
TERRAFORM = Grammar(
    "terraform",
    [
        Rule(
            "terraform_{1}",
            r"""^\s*(resource|data|module|variable|output|provider|locals)\s*(?:"([^"]+)")?\s*(?:"([^"]+)")?""",
            name=lambda w, m: ".".join(x for x in m.groups()[1:] if x) or m.group(1),
            on="line",
        )
    ],
    skip=never,
    squeezes=False,
)

# ---- R and Apple languages

R_RULES = [
    Rule("rmarkdown_chunk", r"^```\{r\s*([^,}]*)?", name=lambda w, m: (m.group(1) or "").strip(SPACES) or "r_chunk"),
    Rule("r_function", rf"^\s*({ID})\s*(?:<-|=)\s*function\s*\(([^)]*)\)", params=(2, "value")),
    Rule("r_package", rf"\b(?:library|require)\s*\(\s*({ID})\s*\)"),
    Rule("r_variable", rf"^\s*({ID})\s*(?:<-|=)"),
]
R = Grammar("r", R_RULES, skip=hash_or_blank, squeezes=False)
RMARKDOWN = Grammar("rmarkdown", R_RULES, skip=hash_or_blank, squeezes=False)
SWIFT = Grammar(
    "swift",
    [
        Rule("swift_import", rf"^\s*import\s+({ID})"),
        Rule("swift_{1}", rf"^\s*(?:public|private|internal|open|final|actor\s+)*\s*(class|struct|enum|protocol|actor|extension)\s+({ID})", name="{2}"),
        Rule(
            "swift_function",
            rf"^\s*(?:public|private|internal|open|static|class|override|mutating|async\s+)*func\s+({ID})\s*\(([^)]*)\)\s*(?:->\s*([^{{]+))?",
            params=(2, "colon"),
            returns="{3}",
        ),
        Rule("swift_property", rf"^\s*(?:public|private|internal|static|let|var)\s+(?:let|var\s+)?({ID})\s*(?::\s*([^={{]+))?", returns="{2}"),
    ],
    strip=cut_at("//"),
    skip=never,
    squeezes=False,
)
OBJC_RULES = [
    Rule("objc_import", r"""^\s*#import\s+[<"]([^>"]+)[>"]"""),
    Rule("objc_type", rf"^\s*@(?:interface|implementation|protocol)\s+({ID})"),
    Rule("objc_method", r"^\s*[-+]\s*\(([^)]+)\)\s*([A-Za-z_][A-Za-z0-9_:]*)", name="{2}", returns="{1}"),
    Rule("objc_property", rf"^\s*@property\b.*\s+({ID})\s*;"),
]
OBJC = Grammar("objective-c", OBJC_RULES, strip=cut_at("//"), skip=never, squeezes=False)
OBJC_M = Grammar("objective-c", OBJC_RULES, strip=cut_at("//"), skip=never)

# ---- build files


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


def first_argument(walk: Walk, m: re.Match) -> str:
    # the command is recognised in any case, but its argument only after the lower-case spelling
    inside = re.search(re.escape(m.group(1).lower()) + r"\(\s*([^\s)]*)", walk.code)
    return unquoted(inside.group(1)) if inside else ""


CMAKE = Grammar(
    "cmake",
    [Rule(lambda w, m: "cmake_project" if m.group(1).lower() == "project" else "cmake_target", r"^(project|add_executable|add_library)\(", name=first_argument, flags=re.I)],
    skip=never,
    squeezes=False,
)
MAKE = Grammar(
    "make",
    [Rule("make_target", r"^\s*([A-Za-z0-9_\-\.]+)\s*:\s*([^=].*)?$", name=lambda w, m: "" if m.group(1)[0] == "." else m.group(1))],
    skip=never,
    squeezes=False,
)
SOLUTION = Grammar("solution", [Rule("solution_project", r'^Project\([^)]*\)\s*=\s*"([^"]+)",\s*"([^"]+)"', returns="{2}")], skip=never, squeezes=False)


def project(walk: Walk) -> None:
    walk.code = walk.path
    name, last = stem(walk.path), walk.lines[-1] if walk.lines else Line("", 0)
    walk.emit("project", name, line=0)
    size = walk.vars["bytes"]
    walk.symbols[0].update(signature=walk.path, line_end=max(1, len(walk.lines)), char_start=0, char_end=size, char_count=size)
    walk.vars.update(section=name, section_symbol=0, last=last)


def reference(kind: str, word: str, name) -> Rule:
    return Rule(
        kind,
        word,
        name=name,
        within="section",
        qualified=lambda w, m, n: f"{w.vars['section']}.{attribute(w.code, 'Include', True)}",
        extra=lambda w, m: {"find": "<"},
        flags=re.I,
    )


PROJECT_RULES = [
    reference("package_reference", "<packagereference", lambda w, m: attribute(w.code, "Include", True)),
    reference("project_reference", "<projectreference", lambda w, m: stem(attribute(w.code, "Include", True))),
]
MSBUILD = Grammar("msbuild", PROJECT_RULES, skip=never, squeezes=False, start=project)
JUCE = Grammar("juce", PROJECT_RULES, skip=never, squeezes=False, start=project)


def xaml_root(walk: Walk, m: re.Match) -> str:
    walk.vars["section"] = attribute(walk.code, "x:Class", True) or stem(walk.path)
    return walk.vars["section"].rsplit(".", 1)[-1]


def xaml_opened(walk: Walk, m: re.Match, index: int) -> None:
    walk.symbols[index]["line_end"] = max(1, len(walk.lines))
    walk.vars["section_symbol"] = index


XAML = Grammar(
    "xaml",
    [
        Rule("xaml_class", TAG, name=xaml_root, returns="{1}", only=lambda w: "section_symbol" not in w.vars, qualified=lambda w, m, n: w.vars["section"], also=xaml_opened, falls=True, extra=lambda w, m: {"find": "<"}),
        Rule("xaml_element", TAG, name=lambda w, m: attribute(w.code, "x:Name", True) or attribute(w.code, "Name", True), within="section", returns="{1}", extra=lambda w, m: {"find": "<"}),
    ],
    skip=never,
    squeezes=False,
)

# ---- web

JS_WORDS = ("if", "for", "while", "switch", "catch", "return", "function", "else")
ANGULAR = {"@Component": "angular_component", "@Injectable": "angular_service", "@NgModule": "angular_module", "@Directive": "angular_directive", "@Pipe": "angular_pipe"}


def angular(walk: Walk) -> bool:
    for mark, kind in ANGULAR.items():
        if walk.code.startswith(mark):
            walk.vars["pending"] = kind
    return False


def js_class(walk: Walk, m: re.Match) -> str:
    kind = walk.vars.pop("pending", "")
    return kind or ("react_component" if m.group(1)[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and "extends React" in walk.code else "js_class")


def js_function(walk: Walk, m: re.Match) -> str:
    name = m.group(1)
    return "react_component" if "A" <= name[0] <= "Z" else "react_hook" if name.startswith("use") else "js_function"


def script(language: str) -> Grammar:
    return Grammar(
        language,
        [
            Rule(js_class, rf"^\s*(?:export\s+default\s+|export\s+)?class\s+({JS_ID})", block=True, opens=True),
            Rule(js_function, rf"^\s*(?:export\s+)?(?:async\s+)?function\s+({JS_ID})\s*\(([^)]*)\)", params=(2, "colon"), block=True),
            Rule(js_function, rf"^\s*(?:export\s+)?(?:const|let|var)\s+({JS_ID})\s*[:A-Za-z0-9_<>,\s\[\]\|&?]*=\s*(?:async\s*)?\(([^)]*)\)\s*=>", params=(2, "colon"), block=True),
            Rule("ts_{1}", rf"^\s*(?:export\s+)?(interface|type|enum)\s+({JS_ID})", name="{2}", block=True),
            Rule(
                "js_method",
                rf"^\s*(?:async\s+)?({JS_ID})\s*\(([^)]*)\)\s*\{{?",
                name=lambda w, m: "" if m.group(1) in JS_WORDS else m.group(1),
                only=lambda w: w.type is not None and w.depth == w.type.close,
                within="type",
                params=(2, "colon"),
                block=True,
            ),
        ],
        strip=cut_at("//"),
        scopes="after",
        types=("js_class", "react_component", "angular_component", "angular_service", "angular_module"),
        each_line=angular,
        counts_skipped=False,
    )


JAVASCRIPT, TYPESCRIPT, JSX = script("javascript"), script("typescript"), script("jsx")
MARKUP_RULES = [
    Rule("html_id", TAG, name=lambda w, m: attribute(w.code, "id"), returns="{1}", falls=True),
    Rule("html_class", TAG, name=lambda w, m: squeeze(attribute(w.code, "class")).split(" "), returns="{1}"),
]
HTML = Grammar("html", MARKUP_RULES, skip=never)
CSS = Grammar(
    "css",
    [
        Rule("css_keyframes", r"^@keyframes\S*(?:\s+(\S+))?"),
        Rule("css_selector", r"^([^{]*)\{", name=lambda w, m: [s.strip(SPACES) for s in m.group(1).split(",")]),
        Rule("css_custom_property", r"^(--[^:]*):", name=lambda w, m: m.group(1).strip(SPACES)),
    ],
    skip=never,
)


def json_value(walk: Walk, m: re.Match) -> str:
    text = m.group(2).strip(SPACES)
    return text[:-1].strip(SPACES) if text.endswith(",") else text


def json_opened(walk: Walk, m: re.Match, index: int) -> None:
    value = json_value(walk, m)
    if value[:1] in ("{", "[") and "}" not in value and "]" not in value:
        walk.vars.setdefault("objects", []).append(m.group(1))


def npm_section(walk: Walk, m: re.Match) -> None:
    marks = {"npm_script": ('"scripts"',), "npm_dependency": ('"dependencies"', '"devDependencies"')}
    walk.vars["scan"] = walk.code
    for kind, words in marks.items():
        if any(word in walk.code for word in words):
            walk.vars["npm"], walk.vars["scan"] = kind, walk.code.partition("{")[2]


def json_closed(walk: Walk, m: re.Match) -> None:
    walk.vars["npm"] = ""
    if walk.vars.get("objects"):
        walk.vars["objects"].pop()


def json_grammar(language: str) -> Grammar:
    pair = re.compile(r'"([^"]*)"(\s*:)?', re.ASCII)
    return Grammar(
        language,
        [
            Rule(
                lambda w, m: "json_object" if json_value(w, m)[:1] in ("{", "[") else "json_property",
                r'^"([^"]*)"\s*:(.*)$',
                qualified=lambda w, m, n: ".".join([*w.vars.get("objects", []), n]),
                returns=json_value,
                also=json_opened,
                falls=True,
            ),
            Rule("", "", act=npm_section, falls=True),
            Rule(lambda w, m: w.vars["npm"], "", only=has("npm"), name=lambda w, m: [k for k, colon in pair.findall(w.vars["scan"]) if colon], falls=True),
            Rule("", r"\}", act=json_closed),
        ],
        skip=never,
    )


JSON, NPM = json_grammar("json"), json_grammar("npm")

# ---- Python and its configuration


def decorators(walk: Walk) -> bool:
    if walk.code.startswith("@"):
        walk.vars.setdefault("waiting", []).append(walk.code)
        return True
    walk.vars["decorators"] = walk.vars.pop("waiting", [])
    return False


def python_function(walk: Walk, m: re.Match) -> str:
    if any(".route" in d or "@route" in d for d in walk.vars["decorators"]):
        return "python_route"
    return f"python_{'async_' if m.group(1) else ''}{'method' if walk.type else 'function'}"


ASSIGNMENT = rf"^\s*({ID})\s*(?::\s*([^=]+))?\s*="
PYTHON = Grammar(
    "python",
    [
        Rule("python_class", rf"^\s*class\s+({ID})\s*(?:\(([^)]*)\))?\s*:", on="line", within="type", returns="{2}", block=True, opens=True),
        Rule(
            python_function,
            rf"^\s*(async\s+)?def\s+({ID})\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?\s*:",
            on="line",
            name="{2}",
            within="type",
            params=(3, "colon_value"),
            returns="{4}",
            block=True,
            extra=lambda w, m: {"modifiers": " ".join((["async"] if m.group(1) else []) + w.vars["decorators"])},
        ),
        Rule("python_import", r"^\s*(?:from\s+([A-Za-z0-9_\.]+)\s+import\s+(.+)|import\s+(.+))", on="line", name=lambda w, m: m.group(1) or m.group(3) or "import"),
        Rule("python_variable", ASSIGNMENT, on="line", only=lambda w: w.indent == 0, returns="{2}"),
        Rule("python_field", ASSIGNMENT, on="line", only=lambda w: w.type is not None and w.indent > w.type.close, within="type", returns="{2}"),
    ],
    skip=hash_or_blank,
    scopes="indent",
    types=("python_class",),
    each_line=decorators,
)


def requirement(text: str) -> str:
    text = text.strip(SPACES)
    return "" if text[:1] in ("", "#", "-") else re.split(r"[<>=!~\[ ;]", text)[0].strip(SPACES)


def quoted_requirements(text: str) -> list[str]:
    found = []
    for _, inside in re.findall(r"""(["'])(.*?)\1""", text):
        inside = inside.strip(SPACES)
        inside = inside[1:] if inside[:1] in ('"', "'") and inside else inside
        inside = inside[:-1] if inside[-1:] in ('"', "'", ",") and inside else inside
        found.append(requirement(inside))
    return [f for f in found if f]


REQUIREMENTS = Grammar("python-requirements", [Rule("python_dependency", ".", name=lambda w, m: requirement(w.code))], skip=never)
PY_SECTION = Rule("python_config_section", r"^\[([^\]]*)\]", also=enter_section)
DEPENDENCY_SECTIONS = ("packages", "dev-packages", "requires")
DEPENDENCY_KEYS = ("dependencies", "requires", "install_requires")


def toml_kind(walk: Walk, m: re.Match) -> str:
    section = walk.vars.get("section", "")
    return "python_dependency" if "dependencies" in section or section in DEPENDENCY_SECTIONS else "python_config_property"


def toml_list(walk: Walk, m: re.Match, index: int) -> None:
    if walk.symbols[index]["name"] in DEPENDENCY_KEYS:
        for name in quoted_requirements(m.group(2)):
            walk.emit("python_dependency", name, parent=walk.vars.get("section_symbol", -1))


def key_name(walk: Walk, m: re.Match) -> str:
    return m.group(1).strip(SPACES)


INI = Grammar("python-config", [PY_SECTION, Rule("python_config_property", "^([^=]*)=", name=key_name, within="section")], skip=hash_or_blank)
TOML = Grammar("python-toml", [PY_SECTION, Rule(toml_kind, "^([^=]*)=(.*)$", name=key_name, within="section", also=toml_list)], skip=hash_or_blank)

# ---- MATLAB, Octave, Scilab


def matlab_name(text: str) -> str:
    return text.strip(SPACES).rstrip(";," + SPACES)


def open_properties(walk: Walk, m: re.Match) -> None:
    owner = walk.type
    walk.stack.append(Scope("matlab_properties_block", "properties", owner.qualified if owner else "", owner.symbol if owner else -1, 0, walk.at + 1))


def in_callable(walk: Walk) -> bool:
    return any(s.kind in ("matlab_function", "matlab_method", "scilab_function") for s in walk.stack)


M_FUNCTION = r"^\s*function\s+(?:(?:\[[^\]]+\]|[A-Za-z]\w*)\s*=\s*)?([A-Za-z]\w*)\s*(?:\(([^)]*)\))?"
MATLAB = Grammar(
    "matlab-octave",
    [
        Rule("matlab_section", r"^\s*%%(.*)$", on="line", name=lambda w, m: matlab_name(m.group(1)), extra=lambda w, m: {"signature": w.lines[w.at].text}),
        Rule("matlab_class", r"^\s*classdef(?:\s*\([^)]*\))?\s+([A-Za-z]\w*)(?:\s*<\s*(.+))?", returns="{2}", opens=True),
        Rule("", "^properties", act=open_properties, flags=re.I),
        Rule("", "^end(?: |$)", act=lambda w, m: w.close_one(w.at + 1), flags=re.I),
        Rule(lambda w, m: "matlab_method" if w.type else "matlab_function", M_FUNCTION, within="type", params=(2, "name"), opens=True),
        Rule("matlab_property", r"^\s*([A-Za-z]\w*)\s*(?:\([^)]*\))?\s*(?:=.*)?$", only=lambda w: bool(w.stack) and w.stack[-1].kind == "matlab_properties_block", within="type"),
        Rule(lambda w, m: "matlab_property" if w.type else "matlab_variable", r"^\s*([A-Za-z]\w*)\s*=", only=lambda w: not in_callable(w), within="type"),
    ],
    strip=percent_outside_quotes,
    skip=never,
    scopes="end",
    types=("matlab_class",),
)
SCILAB = Grammar(
    "scilab",
    [
        Rule("", "^endfunction$", act=lambda w, m: w.close_one(w.at + 1), flags=re.I),
        Rule("scilab_function", M_FUNCTION, params=(2, "name"), opens=True),
        Rule("scilab_function", r"""^\s*deff\s*\(\s*['"][^=]*=\s*([A-Za-z]\w*)\s*\(([^)]*)\)""", params=(2, "name"), opens=True),
        Rule("scilab_variable", r"^\s*([A-Za-z]\w*)\s*=", only=lambda w: not w.stack),
    ],
    strip=slashes_outside_quotes,
    scopes="end",
)

# ---- JVM

J_TYPE = "[A-Za-z_][A-Za-z0-9_<>,.? \\[\\]]+"
JAVA = Grammar(
    "java",
    [
        Rule("java_package", r"^\s*package\s+([A-Za-z_][A-Za-z0-9_.]*)", also=remember("package")),
        Rule("java_import", r"^\s*import\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.*]*)"),
        Rule("java_{1}", rf"^\s*(?:(?:public|private|protected|abstract|final|static|sealed|non-sealed)\s+)*(class|interface|enum|record)\s+({ID})(.*)", name="{2}", within="type or package", block=True, opens=True),
        Rule(lambda w, m: "java_constructor" if m.group(1) == w.type.name else None, rf"^\s*(?:(?:public|private|protected)\s+)?({ID})\s*\(([^)]*)\)\s*\{{?", only=in_type, within="type", params=(2, "last"), block=True),
        Rule(
            "java_method",
            rf"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*({J_TYPE})\s+({ID})\s*\(([^)]*)\)\s*(?:throws\s+[^{{]+)?\{{?",
            name="{2}", only=in_type, within="type", returns="{1}", params=(3, "last"), block=True,
        ),
        Rule("java_field", rf"^\s*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*({J_TYPE})\s+({ID})\s*(?:=.*)?;", name="{2}", only=in_type, within="type", returns="{1}"),
    ],
    strip=slashes_outside_strings,
    skip=lambda t: not t or t.startswith(("*", "/*")),
    scopes="before",
    types=("java_class", "java_interface", "java_enum", "java_record"),
)
KOTLIN = Grammar(
    "kotlin",
    [
        Rule("kotlin_package", r"^\s*package\s+([A-Za-z_][A-Za-z0-9_.]*)", also=remember("package")),
        Rule("kotlin_import", r"^\s*import\s+([A-Za-z_][A-Za-z0-9_.*]*)"),
        Rule("kotlin_{1}", rf"^\s*(?:(?:data|sealed|open|abstract|inner|enum)\s+)*(class|interface|object)\s+({ID})(.*)", name="{2}", within="type or package", block=True, opens=True),
        Rule(
            lambda w, m: "kotlin_method" if w.type else "kotlin_function",
            rf"^\s*(?:(?:public|private|protected|internal|open|override|suspend|inline|operator)\s+)*fun\s+(?:[A-Za-z_][A-Za-z0-9_.<>]*\.)?({ID})\s*\(([^)]*)\)\s*(?::\s*([A-Za-z_][A-Za-z0-9_.<>?]*))?",
            within="type or package", params=(2, "colon_value"), returns="{3}", block=True,
        ),
        Rule(
            lambda w, m: "kotlin_property" if w.type else "kotlin_variable",
            rf"^\s*(?:(?:public|private|protected|internal|override|lateinit|const)\s+)*(val|var)\s+({ID})\s*(?::\s*([^=]+))?",
            name="{2}", within="type or package", returns="{3}",
        ),
    ],
    strip=slashes_outside_strings,
    scopes="before",
    types=("kotlin_class", "kotlin_interface", "kotlin_object"),
)


def inner_text(text: str, tag: str) -> str:
    opened, closed = text.find(f"<{tag}>"), text.find(f"</{tag}>")
    return text[opened + len(tag) + 2 : closed].strip(SPACES) if 0 <= opened < closed else ""


def pom_opened(walk: Walk, m: re.Match) -> None:
    walk.vars["open"] = {"line": walk.at, "groupId": "", "artifactId": ""}


def pom_inside(walk: Walk, m: re.Match) -> None:
    state = walk.vars["open"]
    for tag in ("groupId", "artifactId"):
        state[tag] = inner_text(walk.code, tag) or state[tag]
    if "</dependency>" in walk.code:
        name = ":".join(x for x in (state["groupId"], state["artifactId"]) if x)
        if state["artifactId"]:
            walk.emit("maven_dependency", name, line=state["line"], signature=name)
        walk.vars["open"] = None


MAVEN = Grammar(
    "maven",
    [
        Rule("", "<dependency>", act=pom_opened),
        Rule("", "", only=has("open"), act=pom_inside),
        Rule("maven_artifact", "<artifactId>", name=lambda w, m: inner_text(w.code, "artifactId")),
    ],
    skip=never,
)
GRADLE = Grammar(
    "gradle",
    [
        Rule("gradle_dependency", r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation|classpath)\s*\(?\s*['"]([^'"]+)['"]""", falls=True),
        Rule("gradle_plugin", r"""id\s+['"]([^'"]+)['"]""", falls=True),
        Rule("gradle_task", rf"""\btask\s+({ID})|tasks\.register\s*\(\s*['"]([^'"]+)['"]""", name=lambda w, m: m.group(1) or m.group(2)),
    ],
    strip=slashes_outside_strings,
    skip=never,
)

# ---- Go

G_RESULT = r"([A-Za-z_][A-Za-z0-9_.*\[\]]*)?"
GO = Grammar(
    "go",
    [
        Rule("go_package", rf"^\s*package\s+({ID})", also=remember("package")),
        Rule("", r"^import ?\($", act=flag("imports")),
        Rule("", r"^\)$", only=has("imports"), act=flag("imports", False)),
        Rule("go_import", rf'^\s*(?:import\s+)?(?:{ID}\s+)?"([^"]+)"', only=lambda w: w.vars.get("imports") or w.code.startswith("import")),
        Rule("go_method", rf"^\s*func\s+\(([^)]*)\)\s+({ID})\s*\(([^)]*)\)\s*{G_RESULT}", name="{2}", within="package", params=(3, "first"), returns="{4}", block=True),
        Rule("go_function", rf"^\s*func\s+({ID})\s*\(([^)]*)\)\s*{G_RESULT}", within="package", params=(2, "first"), returns="{3}", block=True),
        Rule("go_{2}", rf"^\s*type\s+({ID})\s+(struct|interface)\b", within="package", block=True),
        Rule("go_type", rf"^\s*type\s+({ID})\s+(.+)", within="package", returns="{2}"),
        Rule("go_variable", rf"^\s*(?:var|const)\s+({ID})\b", within="package"),
    ],
    strip=slashes_outside_escaped,
)
GO_MOD = Grammar(
    "go-module",
    [
        Rule("go_module", r"^\s*module\s+(\S+)"),
        Rule("", r"^require ?\($", act=flag("requires")),
        Rule("", r"^\)$", only=has("requires"), act=flag("requires", False)),
        Rule("go_dependency", r"^\s*(?:require\s+)?([A-Za-z0-9_.\-/]+)\s+v?[A-Za-z0-9_.+\-]+", only=lambda w: w.vars.get("requires") or w.code.startswith("require"), name=lambda w, m: "" if m.group(1) == "require" else m.group(1)),
    ],
    strip=slashes_outside_escaped,
)
GO_SUM = Grammar("go-sum", [Rule("go_dependency", r"^\s*([A-Za-z0-9_.\-/]+)\s+v?[A-Za-z0-9_.+\-/]+")], skip=never)

# ---- Rust

RUST_SCOPES = ("rust_struct", "rust_enum", "rust_trait", "rust_impl", "rust_module")
R_PATH = "[A-Za-z_][A-Za-z0-9_:<>]*"


def opens_brace(walk: Walk, m: re.Match) -> bool:
    return "{" in walk.code


RUST = Grammar(
    "rust",
    [
        Rule("rust_use", r"^\s*use\s+([^;]+);", name=lambda w, m: m.group(1).strip(SPACES)),
        Rule("rust_{1}", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait)\s+({ID})", name="{2}", within="scope", block=True, opens=True),
        Rule("rust_impl", rf"^\s*impl(?:\s*<[^>]+>)?(?:\s+({R_PATH}))?(?:\s+for\s+({R_PATH}))?", name=lambda w, m: m.group(2) or m.group(1) or "", only=lambda w: "{" in w.code, block=True, opens=True),
        Rule("rust_module", rf"^\s*(?:pub\s+)?mod\s+({ID})", block=opens_brace, opens=opens_brace),
        Rule(
            lambda w, m: "rust_method" if w.owner and w.owner.kind == "rust_impl" else "rust_function",
            rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+({ID})\s*\(([^)]*)\)\s*(?:->\s*([^{{;]+))?",
            within="scope", params=(2, "colon"), returns="{3}", block=True,
        ),
        Rule("rust_constant", rf"^\s*(?:pub\s+)?(?:const|static)\s+({ID})\s*:"),
        Rule(lambda w, m: "rust_macro" if m.group(1) else "rust_macro_call", rf"^\s*macro_rules!\s+({ID})|^\s*({ID})!\s*\(", name=lambda w, m: m.group(1) or m.group(2)),
    ],
    strip=slashes_outside_escaped,
    skip=lambda t: not t or t.startswith("#["),
    separator="::",
    scopes="before",
    types=RUST_SCOPES,
)


def unquote_any(text: str) -> str:
    text = text.strip(SPACES)
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def cargo_kind(walk: Walk, m: re.Match) -> str:
    section = walk.vars.get("section", "")
    if section == "package" and m.group(1) == "name":
        return "cargo_package"
    return "cargo_dependency" if "dependencies" in section else "cargo_property"


def cargo_qualified(walk: Walk, m: re.Match, name: str) -> str:
    return walk.qualify("section", name) if cargo_kind(walk, m) == "cargo_property" else name


CARGO = Grammar(
    "cargo",
    [
        Rule("cargo_section", r"^\s*\[([^\]]+)\]", also=remember("section")),
        Rule(cargo_kind, r"^\s*([A-Za-z0-9_.\-]+)\s*=\s*(.+)", name=lambda w, m: unquote_any(m.group(2)) if cargo_kind(w, m) == "cargo_package" else m.group(1), qualified=cargo_qualified),
    ],
    skip=hash_or_blank,
)
CARGO_LOCK = Grammar(
    "cargo-lock",
    [
        Rule("", r"^\[\[package\]\]$", act=flag("package")),
        Rule("cargo_dependency", r'^\s*name\s*=\s*"([^"]+)"', only=has("package"), also=lambda w, m, i: w.vars.update(package=False)),
    ],
    skip=never,
)

# ---- PHP

P_TYPE = r"[A-Za-z_\\?][A-Za-z0-9_\\|?]*"
PHP = Grammar(
    "php",
    [
        Rule("php_namespace", r"^\s*namespace\s+([A-Za-z_\\][A-Za-z0-9_\\]*)", also=remember("package")),
        Rule("php_use", r"^\s*use\s+([^;]+);", name=lambda w, m: m.group(1).strip(SPACES)),
        Rule("php_{1}", rf"^\s*(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+({ID})(.*)", name="{2}", within="package", block=True, opens=True),
        Rule(
            lambda w, m: "php_function" if not w.type else "php_constructor" if m.group(1) == "__construct" else "php_method",
            rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+({ID})\s*\(([^)]*)\)\s*(?::\s*({P_TYPE}))?",
            within="type or package", params=(2, "dollar"), returns="{3}", block=True,
        ),
        Rule("php_property", rf"^\s*(?:(?:public|private|protected|static|readonly)\s+)+(?:(?:{P_TYPE}|\?[\w\\]+)\s+)?(\${ID})\s*(?:=.*)?;", only=in_type, within="type"),
        Rule("php_constant", rf"^\s*(?:(?:public|private|protected)\s+)?const\s+({ID})\s*=", only=in_type, within="type"),
    ],
    strip=php_comment,
    skip=lambda t: not t or t == "<?php" or t.startswith(("/*", "*")),
    separator="\\",
    scopes="before",
    types=("php_class", "php_interface", "php_trait", "php_enum"),
    keeps_open=lambda t: t == "{",
)


def composer_section(walk: Walk, m: re.Match) -> None:
    for name in ("require", "require-dev", "autoload"):
        if f'"{name}"' in walk.code:
            walk.vars["part"] = name
            return


def composer_name(walk: Walk, m: re.Match) -> str:
    found = re.search(r':[^"]*"([^"]*)"', walk.code)
    return found.group(1) if found else ""


def composer_closed(walk: Walk, m: re.Match) -> None:
    if walk.vars.get("part") != "autoload":
        walk.vars["part"] = ""


COMPOSER = Grammar(
    "composer",
    [
        Rule("", "", act=composer_section, falls=True),
        Rule("composer_package", '^"name"', name=composer_name, falls=True),
        Rule("composer_dependency", r'^(?!"name")"([^"]*)"', only=lambda w: w.vars.get("part") in ("require", "require-dev") and len(w.code) > 2, name=lambda w, m: "" if m.group(1) in ("require", "require-dev") else m.group(1), falls=True),
        Rule("composer_autoload", r'^(?!"name").*"psr-4"', only=lambda w: w.vars.get("part") == "autoload", name="psr-4", qualified=lambda w, m, n: "autoload.psr-4", falls=True),
        Rule("", r"\}", act=composer_closed),
    ],
)

# ---- Ruby


def ruby_attributes(walk: Walk, m: re.Match) -> list[str]:
    return [a.strip(SPACES).lstrip(":'\"").rstrip("'\"") for a in m.group(1).split(",")]


RUBY = Grammar(
    "ruby",
    [
        Rule("ruby_module", r"^\s*module\s+([A-Z][A-Za-z0-9_:]*)", within="scope", opens=True),
        Rule("ruby_class", r"^\s*class\s+([A-Z][A-Za-z0-9_:]*)(?:\s*<\s*([A-Za-z0-9_:]+))?", within="scope", returns="{2}", opens=True),
        Rule(
            lambda w, m: "ruby_method" if w.stack else "ruby_function",
            r"^\s*def\s+(?:self\.)?([A-Za-z_][A-Za-z0-9_!?=]*)(?:\(([^)]*)\)|\s+([^#]+))?",
            within="scope",
            params=(lambda m: m.group(3) or "" if m.group(2) is None else m.group(2), "value"),
            opens=True,
        ),
        Rule("", "^end$", act=lambda w, m: w.close_one(w.at + 1)),
        Rule("ruby_constant", r"^\s*([A-Z][A-Za-z0-9_]*)\s*=", within="scope"),
        Rule("ruby_attribute", r"^\s*attr_(?:reader|writer|accessor)\s+(.+)", name=ruby_attributes, within="scope"),
        Rule("rails_route", r"""^\s*(get|post|put|patch|delete|resources|resource)\s+[:'"]?([^,'"\s)]+)""", name="{2}", returns="{1}"),
    ],
    strip=hash_outside_quotes,
    separator="::",
    scopes="end",
    types=("ruby_module", "ruby_class", "ruby_method", "ruby_function"),
)
GEM_RULES = [
    Rule("ruby_gem", r"""(?:\bgem|\.add_(?:runtime_)?dependency|\.add_development_dependency)\s+['"]([^'"]+)['"]"""),
    Rule("ruby_gemspec", r"""\.name\s*=\s*['"]([^'"]+)['"]"""),
]
GEMFILE, GEMSPEC = (Grammar(x, GEM_RULES, strip=hash_outside_quotes, skip=never) for x in ("gemfile", "gemspec"))

# ---- C and C++

CPP_WORDS = ("if", "for", "while", "switch", "return", "catch", "else", "do", "delete", "new")
CPP_NAME = re.compile(r"[A-Za-z_~][A-Za-z0-9_:~]*", re.ASCII)


def words(text: str) -> list[str]:
    return squeeze(text).split(" ") if text.strip(SPACES) else []


def cpp_callable(walk: Walk) -> bool:
    return ";" not in walk.code and not (walk.code and words(walk.code)[0] in CPP_WORDS)


def cpp_name(walk: Walk, m: re.Match) -> str:
    last = (words(m.group(1)) or [""])[-1]
    for signs in ("*&", ":"):  # what a pointer sign or a scope leaves
        tail = re.split(f"[{signs}]", last)[-1]
        last = tail or last
    return last if CPP_NAME.fullmatch(last) else ""


def cpp_kind(walk: Walk, m: re.Match) -> str:
    own = walk.type.name if walk.type else None
    return "constructor" if own and cpp_name(walk, m) in (own, "~" + own) else "function"


def cpp_returns(walk: Walk, m: re.Match) -> str:
    head = m.group(1).strip(SPACES)
    return head[: max(0, head.rfind(cpp_name(walk, m)))]


def cpp_field(walk: Walk, m: re.Match) -> str:
    said = words(m.group(1))
    name = said[-1].split("=")[0] if len(said) > 1 else ""
    return name if CPP_NAME.fullmatch(name) else ""


CPP = Grammar(
    "cpp",
    [
        Rule("macro", r"^#define (?:\s*)([^\s(]*)", within="scope", child=False),
        Rule("namespace", r"^\s*namespace\s+([A-Za-z_][A-Za-z0-9_:]*)\s*\{?", within="scope", child=False, opens=True),
        Rule("{1}", rf"^\s*(class|struct|enum)\s+(class\s+)?({ID})[^;]*\{{?", name="{3}", within="scope", extra=lambda w, m: {"parent_index": w.type.symbol if w.type else -1}, opens=True),
        Rule(cpp_kind, r"^([^(]*)\(([^)]*)\)", name=cpp_name, only=cpp_callable, within="scope", extra=lambda w, m: {"parent_index": w.type.symbol if w.type else -1}, returns=cpp_returns, params=(2, "pair_void"), block=True),
        Rule("field", "^([^;(]*);[^(]*$", name=cpp_field, only=lambda w: w.type is not None and w.depth == w.type.close, within="type", returns=lambda w, m: words(m.group(1))[-2]),
    ],
    strip=cut_at("//"),
    separator="::",
    scopes="after",
    types=("class", "struct"),
    owners=("namespace", "class", "struct"),
    blocks="match",
    counts_skipped=False,
)

# ---- C#

CS_MODIFIERS = ("public", "private", "protected", "internal", "static", "async", "virtual", "override", "abstract", "sealed", "readonly", "partial", "extern", "const", "volatile")
CS_VISIBILITY = ("public", "private", "protected", "internal")
CS_STATEMENTS = ("return", "throw", "break", "continue", "if", "for", "foreach", "while", "switch", "using")
CS_NAME = re.compile(r"[A-Za-z_@][A-Za-z0-9_@<>\[\]?.]*", re.ASCII)
CS_OPERATORS = re.compile(r"\+=|-=|=>|==|!=|<=|>=")


def cs_modifiers(before: str) -> dict:
    found = " ".join(w for w in words(before) if w in CS_MODIFIERS)
    return {"modifiers": found, "visibility": next((v for v in CS_VISIBILITY if v in found), "")}


def cs_before(walk: Walk, word: str) -> str:
    line = walk.stripped[walk.at]
    return line[: max(0, line.find(word))]


def cs_type(walk: Walk, m: re.Match) -> dict:
    bases = walk.code.partition(":")[2].partition("{")[0].split(",")
    bases = [b for b in (b.strip(SPACES).split("<")[0] for b in bases) if b]
    return {"find": m.group(1), "base_types": bases, "parent_index": walk.type.symbol if walk.type else -1} | cs_modifiers(cs_before(walk, m.group(1)))


def cs_member(walk: Walk, m: re.Match) -> None:
    """A line at member depth: with a parameter list, with a body, or closed by ; or =."""
    owner, line, code = walk.type, walk.stripped[walk.at], walk.code
    statement = (words(code) or [""])[0] in CS_STATEMENTS
    if "{" in line and "(" not in line:
        kind, head = "property", code.partition("{")[0]
    elif "(" in line and ")" in line and not statement:
        kind, head = "method", line.partition("(")[0]
    elif "(" not in line and (";" in line or "=" in line) and not statement:
        kind, head = "field", re.split("[;=]", code)[0]
    else:
        return
    core = [w for w in words(head) if w not in CS_MODIFIERS]
    if not core or CS_OPERATORS.search(code) or not CS_NAME.fullmatch(core[-1]):
        return
    name, before = core[-1], core[-2] if len(core) > 1 else ""
    if kind != "method" and not CS_NAME.fullmatch(before) or kind == "method" and not before and name != owner.name:
        return
    if kind == "method" and name == owner.name:
        kind = "constructor"
    callable_ = kind in ("method", "constructor")
    index = walk.emit(kind, name, f"{owner.qualified}.{name}", owner.symbol, return_type=before, **cs_modifiers(cs_before(walk, name if callable_ else before)))
    if callable_:
        inside = line.partition("(")[2]
        walk.symbols[index]["parameters"] = parameters(inside[: inside.find(")")] if ")" in inside else inside, "pair")
    if kind != "field":
        walk.end_at(index, walk.block_end(walk.at))


CSHARP = Grammar(
    "csharp",
    [
        Rule(
            "namespace",
            r"^namespace \s*([^ {;]*)",
            extra=lambda w, m: {"find": "namespace"},
            opens=lambda w, m: True if "{" in w.stripped[w.at] else 0,
        ),
        Rule("{1}", r"^(?:[^\s{(:;=]+\s+)*?(class|interface|struct|enum)\s+([^\s{(:;=]+)", name="{2}", within="scope", extra=cs_type, opens=True),
        Rule("", "", act=cs_member, only=lambda w: w.type is not None and w.depth == w.type.close),
    ],
    strip=cut_at("//"),
    skip=never,
    scopes="after",
    types=("class", "interface", "struct", "enum"),
    owners=("class", "interface", "struct", "enum", "namespace"),
    blocks="match",
    ends_with_code=True,
)

# ---- which file is read how

#: Whole file names, in lower case.
BY_NAME = {
    "cmakelists.txt": CMAKE, "makefile": MAKE, "package.json": NPM, "requirements.txt": REQUIREMENTS, "constraints.txt": REQUIREMENTS,
    "pyproject.toml": TOML, "pipfile": TOML, "poetry.lock": TOML, "setup.cfg": INI, "tox.ini": INI, "pytest.ini": INI, "mypy.ini": INI,
    "pom.xml": MAVEN, "build.gradle": GRADLE, "settings.gradle": GRADLE, "build.gradle.kts": GRADLE, "settings.gradle.kts": GRADLE,
    "go.mod": GO_MOD, "go.sum": GO_SUM, "cargo.toml": CARGO, "cargo.lock": CARGO_LOCK, "composer.json": COMPOSER, "gemfile": GEMFILE,
    "dockerfile": DOCKER, "docker-compose.yml": YAML, "docker-compose.yaml": YAML, "compose.yml": YAML, "compose.yaml": YAML,
}

#: Extensions, in lower case. A name without a dot is an extension too, and goes to its family's default.
BY_EXTENSION = {
    ".cs": CSHARP, ".csproj": MSBUILD, ".vcxproj": MSBUILD, ".filters": MSBUILD, ".jucer": JUCE, ".xaml": XAML,
    ".c": CPP, ".cc": CPP, ".cpp": CPP, ".cxx": CPP, ".hh": CPP, ".hpp": CPP, ".hxx": CPP, ".ipp": CPP, ".inl": CPP, ".h": OBJC,
    ".cmake": CMAKE, ".sln": SOLUTION, ".mk": MAKE, ".make": MAKE, ".makefile": CMAKE,
    ".js": JAVASCRIPT, ".mjs": JAVASCRIPT, ".cjs": JAVASCRIPT, ".jsx": JSX, ".ts": TYPESCRIPT, ".tsx": TYPESCRIPT,
    ".html": HTML, ".htm": HTML, ".css": CSS, ".scss": CSS, ".sass": CSS, ".less": CSS, ".json": JSON,
    ".py": PYTHON, ".pyw": PYTHON, ".pyi": PYTHON, ".pipfile": INI, ".m": MATLAB, ".mlx": MATLAB,
    ".sci": SCILAB, ".sce": SCILAB, ".tst": SCILAB, ".dem": SCILAB, ".java": JAVA, ".kt": KOTLIN, ".kts": KOTLIN, ".gradle": GRADLE,
    ".go": GO, ".rs": RUST, ".php": PHP, ".rb": RUBY, ".gemspec": GEMSPEC, ".gemfile": RUBY,
    ".sh": SHELL, ".bash": SHELL, ".zsh": SHELL, ".ps1": POWERSHELL, ".psm1": POWERSHELL, ".psd1": POWERSHELL, ".sql": SQL,
    ".yaml": YAML, ".yml": YAML, ".dockerfile": YAML, ".tf": TERRAFORM, ".tfvars": TERRAFORM,
    ".swift": SWIFT, ".mm": OBJC, ".r": R, ".rmd": RMARKDOWN,
}
VUE_EXTENSION = ".vue"

OBJC_MARKS = ("@interface", "@implementation", "@protocol", "#import", "@property")


def extension(path: str) -> str:
    name = file_name(path)
    return name[name.rindex(".") :].lower() if "." in name[1:] else ""


def grammar_of(path: str) -> Grammar | None:
    """By whole name first, then by extension; None if nobody reads the file."""
    return BY_NAME.get(file_name(path).lower()) or BY_EXTENSION.get(extension(path))


def language_of(path: str) -> str | None:
    """What the name says; .m files are only told apart by their content."""
    g = grammar_of(path)
    return g.language if g else "vue" if extension(path) == VUE_EXTENSION else None


def looks_like_objc(lines: list[Line]) -> bool:
    return any(line.text.strip(SPACES).startswith(OBJC_MARKS) for line in lines)


def vue_symbols(path: str, lines: list[Line]) -> list[dict]:
    """Each block is read by its own grammar, with the other blocks' lines left blank, so line numbers stay true."""
    inside = dict.fromkeys(("script", "style", "template"), False)
    part: list[str] = []
    for line in lines:
        low = line.text.strip(SPACES).lower()
        mark = next(((k, opened) for k in inside for tag, opened in ((f"<{k}", True), (f"</{k}>", False)) if tag in low), None)
        if mark:
            inside[mark[0]] = mark[1]
        part.append("" if mark else next((k for k in inside if inside[k]), ""))

    def read(block: str, grammar: Grammar) -> list[dict]:
        return Walk(grammar, path, [line if p == block else Line("", line.start) for line, p in zip(lines, part)]).run()

    flat = sorted(read("style", CSS) + read("template", HTML), key=lambda s: s["line_start"])
    script_symbols = read("script", JAVASCRIPT)
    for s in script_symbols:
        s["parent_index"] += len(flat) if s["parent_index"] >= 0 else 0
    return flat + script_symbols


def parse(path: str, content: bytes) -> tuple[str | None, list[dict]]:
    """(language, symbols) of one file; (None, []) if nobody reads it."""
    grammar = grammar_of(path)
    lines = split_lines(content.decode("latin-1"))
    raw_path = path.encode().decode("latin-1")
    if grammar is None:
        if extension(path) != VUE_EXTENSION:
            return None, []
        language, found = "vue", vue_symbols(raw_path, lines)
    else:
        if grammar is MATLAB and extension(path) == ".m" and looks_like_objc(lines):
            grammar = OBJC_M
        walk = Walk(grammar, raw_path, lines)
        walk.vars["bytes"] = len(content)
        language, found = grammar.language, walk.run()

    def text(v):
        if isinstance(v, str):
            return v.encode("latin-1").decode("utf-8", "replace")
        if isinstance(v, list):
            return [text(x) for x in v]
        return {k: text(x) for k, x in v.items()} if isinstance(v, dict) else v

    return language, [text(s) for s in found]
