"""Shapes of source code, with the symbols they hold, as text.

``@n``, ``@z`` and ``@t`` stand for a part's key, size and name. A symbol is line,
kind, name, container, signature, documentation, body; the file context comes last where there is one.
"""

GO = [
    ("group", "package p\n\n// Grouped docs.\nconst (\n\tA@n, B@n = @z, 2\n\tC = \"{\" // a brace\n)\n\ntype (\n\tS struct { x int }\n\tT []string\n\tU = string\n)\n", [
        (5, "constant", "A@n", "", "A@n, B@n = @z, 2", "Grouped docs.", ""), (5, "constant", "B@n", "", "A@n, B@n = @z, 2", "Grouped docs.", ""),
        (6, "constant", "C", "", "C = \"{\"", "Grouped docs.", ""), (10, "struct", "S", "", "S", "", "struct { x int }"), (11, "type", "T", "", "T []string", "", "")]),
    ("oneline", "// @t\npackage p; func A@n() int { return @z }; func B() {}\nvar x@n = 1 // trailing\nvar y = 2\n", [
        (2, "function", "A@n", "", "func A@n() int", "", "{ return @z }", "@t"), (2, "function", "B", "", "func B()", "", "{}", "@t"),
        (3, "variable", "x@n", "", "x@n = 1", "trailing", "", "@t"), (4, "variable", "y", "", "y = 2", "", "", "@t")]),
    ("types", "package p\n\ntype I@n interface { Do(x int) error; Close() }\n\nfunc New() interface{} { return nil }\n\nfunc Get(s struct{ n int }) map[string]struct{} {\n\treturn nil\n}\n", [
        (3, "interface", "I@n", "", "I@n", "", "interface { Do(x int) error; Close() }"), (3, "method", "Do", "I@n", "Do(x int) error", "", ""), (3, "method", "Close", "I@n", "Close()", "", ""),
        (5, "function", "New", "", "func New() interface{}", "", "{ return nil }"),
        (7, "function", "Get", "", "func Get(s struct{ n int }) map[string]struct{}", "", "{\n\treturn nil\n}")]),
    ("generic", "package p\n\nfunc Map@n[K comparable, V any](m map[K]V) []K { return nil }\n\ntype Set[T comparable] struct {\n\titems map[T]struct{}\n}\n\nfunc (s *Set[T]) Add(x T) { s.items[x] = struct{}{} }\n\ntype A [@z]int\n", [
        (3, "function", "Map@n", "", "func Map@n[K comparable, V any](m map[K]V) []K", "", "{ return nil }"), (5, "struct", "Set", "", "Set[T comparable]", "", "struct {\n\titems map[T]struct{}\n}"),
        (9, "method", "Add", "Set[T]", "func (s *Set[T]) Add(x T)", "", "{ s.items[x] = struct{}{} }"), (11, "type", "A", "", "A [@z]int", "", "")]),
    ("crlf", "package p\r\n\r\n// Doc @n.\r\nfunc A() {\r\n\treturn\r\n}\r\n", [(4, "function", "A", "", "func A()", "Doc @n.", "{\n\treturn\n}")]),
    ("raw", "package p\n\nvar q = `{ \" ( \n func fake() {\n`\n\nfunc real@n() rune { return '{' }\n", [
        (3, "variable", "q", "", "q = `{ \" ( \n func fake() {\n`", "", ""), (7, "function", "real@n", "", "func real@n() rune", "", "{ return '{' }")]),
    ("apart", "package p\n\n// Far away.\n\n// Near @n.\n/* And so\n * on. */\nfunc A() {}\n", [(8, "function", "A", "", "func A()", "Near @n.\nAnd so\non.", "{}")]),
    ("head", "package p\n\nfunc Long(\n\ta int, // first\n\tb int,\n) (int, error) { // inside\n\treturn a, nil\n}\n", [
        (3, "function", "Long", "", "func Long(\n\ta int, // first\n\tb int,\n) (int, error)", "", "{ // inside\n\treturn a, nil\n}")]),
    ("value", "package p\n\nvar f@n = func() {\n\tfunc() {}()\n}\nvar cfg struct{ n int }\nconst Pi, E float64 = 3, 2\n", [
        (3, "variable", "f@n", "", "f@n = func() {\n\tfunc() {}()\n}", "", ""), (6, "variable", "cfg", "", "cfg", "", "struct{ n int }"),
        (7, "constant", "Pi", "", "Pi, E float64 = 3, 2", "", ""), (7, "constant", "E", "", "Pi, E float64 = 3, 2", "", "")]),
    ("broken", "package p\n\n// @search: entry @n\nfunc A() {\n", [(3, "annotation", "annotation:3", "", "", "entry @n", "func A() {")]),
]
PYTHON = [
    ("class", "class C@n(Base, metaclass=M):  # note\n    \"\"\"@t\"\"\"\n    x: int = @z\n    # Get docs.\n    def get(self): return {\"a\": 1}\n    async def run(self,\n                  x):\n        '''Run.'''\n        pass\n", [
        (1, "class", "C@n", "", "class C@n(Base, metaclass=M):  # note", "note\n@t", "\"\"\"@t\"\"\"\n    x: int = @z\n    # Get docs.\n    def get(self): return {\"a\": 1}\n    async def run(self,\n                  x):\n        '''Run.'''\n        pass"),
        (5, "method", "get", "C@n", "def get(self):", "Get docs.", "return {\"a\": 1}"), (6, "method", "run", "C@n", "async def run(self,\n                  x):", "Run.", "'''Run.'''\n        pass")]),
    ("decorated", "@wraps(f)\ndef hidden(): pass\n\n@dataclass\nclass Hidden:\n    def also(self): pass\n\ndef seen@n():\n    return 1\n", [(8, "function", "seen@n", "", "def seen@n():", "", "return 1")]),
    ("constants", "LIMIT@n = @z; OTHER = 2\nlower = 3\nTYPED: int = 4  # four\nA, B = 1, 2\nX == 1\ncfg.y = SAME\n", [
        (1, "constant", "LIMIT@n", "", "LIMIT@n = @z", "", ""), (1, "constant", "OTHER", "", "OTHER = 2", "", ""), (3, "constant", "TYPED", "", "TYPED: int = 4", "four", ""), (6, "constant", "SAME", "", "cfg.y = SAME", "", "")]),
    ("strings", "def f@n():\n    return '''\ndef fake(): pass\n'''\n\ndef g():\n    x = \"#\" + 'it\\'s'\n    return x\n", [
        (1, "function", "f@n", "", "def f@n():", "", "return '''\ndef fake(): pass\n'''"), (6, "function", "g", "", "def g():", "", "x = \"#\" + 'it\\'s'\n    return x")]),
    ("nested", "def outer@n():\n    def inner():\n        pass\n    class Local:\n        def m(self): pass\n    return inner\n\nif True:\n    def guarded(): pass\n", [
        (1, "function", "outer@n", "", "def outer@n():", "", "def inner():\n        pass\n    class Local:\n        def m(self): pass\n    return inner")]),
    ("brackets", "TABLE@n = {\n    'a': [1,\n 2],\n}\n\ndef after(x=(1,\n2)) -> Dict[str, int]:\n    pass\n", [
        (1, "constant", "TABLE@n", "", "TABLE@n = {\n    'a': [1,\n 2],\n}", "", ""), (6, "function", "after", "", "def after(x=(1,\n2)) -> Dict[str, int]:", "", "pass")]),
    ("lines", "TOTAL@n = 1 + \\\n    2\n# one\n# two\n\n# three\ndef f(): pass\n", [(1, "constant", "TOTAL@n", "", "TOTAL@n = 1 + \\\n    2", "", ""), (7, "function", "f", "", "def f():", "three", "pass")]),
    ("crlf", "class A:\r\n    '''Doc @n.'''\r\n    def b(self):\r\n        pass\r\n", [
        (1, "class", "A", "", "class A:", "Doc @n.", "'''Doc @n.'''\n    def b(self):\n        pass"), (3, "method", "b", "A", "def b(self):", "", "pass")]),
    ("tail", "def f@n():\n    pass\n    # inside\n# outside\ndef g():\n    # first\n    \"\"\"no docstring\"\"\"\n    pass\n", [
        (1, "function", "f@n", "", "def f@n():", "", "pass\n    # inside"), (5, "function", "g", "", "def g():", "outside", "# first\n    \"\"\"no docstring\"\"\"\n    pass")]),
    ("broken", "# @filectx: about @n\n# @search: entry\ndef f(:\n    x = (1,\n", [(1, "annotation", "annotation:1", "", "", "about @n", "# @search: entry\ndef f(:\n    x = (1,", "about @n"), (2, "annotation", "annotation:2", "", "", "entry", "def f(:\n    x = (1,", "about @n")]),
]
RUST = [
    ("oneline", "pub trait T@n { fn need(&self); fn given(&self) -> u8 { 1 } }\nimpl T@n for V { fn need(&self) {} }\n", [
        (1, "interface", "T@n", "", "pub trait T@n", "", "{ fn need(&self); fn given(&self) -> u8 { 1 } }"), (1, "method", "need", "T@n", "fn need(&self);", "", ""),
        (1, "method", "given", "T@n", "fn given(&self) -> u8", "", "{ 1 }"), (2, "method", "need", "V", "fn need(&self)", "", "{}")]),
    ("generic", "impl<'a, T: Fn(u8) -> u8> Show<T> for Wrap<'a, T> where T: Clone {\n    /// Shows.\n    pub(crate) const unsafe fn show(&'a self, c: char) -> Option<T> { None } // end\n}\n", [
        (3, "method", "show", "Wrap<'a, T>", "pub(crate) const unsafe fn show(&'a self, c: char) -> Option<T>", "Shows.\nend", "{ None }")]),
    ("structs", "pub struct Unit@n;\nstruct Pair<T>(T, u8) where T: Copy;\nstruct Named<const N: usize> where [u8; N]: Sized { x: [u8; N] }\nenum E { A { x: u8 }, B(u8) }\n", [
        (1, "struct", "Unit@n", "", "pub struct Unit@n;", "", ""), (2, "struct", "Pair", "", "struct Pair<T>", "", "(T, u8)"),
        (3, "struct", "Named", "", "struct Named<const N: usize> where [u8; N]: Sized", "", "{ x: [u8; N] }"), (4, "enum", "E", "", "enum E", "", "{ A { x: u8 }, B(u8) }")]),
    ("attributes", "/// Lost.\n#[derive(Debug)]\npub struct A@n {}\n#[inline]\n/// Kept.\nfn b() {}\n", [(3, "struct", "A@n", "", "pub struct A@n", "", "{}"), (6, "function", "b", "", "fn b()", "Kept.", "{}")]),
    ("values", "pub const TABLE@n: [u8; 2] = [1, 2];\nstatic mut COUNT: u32 = { 1 + 2 };\ntype Alias<T> = Vec<T>;\nconst fn five() -> u8 { 5 }\n", [
        (1, "constant", "TABLE@n", "", "pub const TABLE@n: [u8; 2] = [1, 2];", "", ""), (2, "variable", "COUNT", "", "static mut COUNT: u32 = { 1 + 2 };", "", ""),
        (3, "type", "Alias", "", "type Alias<T> = Vec<T>;", "", ""), (4, "function", "five", "", "const fn five() -> u8", "", "{ 5 }")]),
    ("literals", "fn a@n() -> char { '{' }\nfn b() -> &'static str { r#\"} \" fn fake() {\"# }\n/* outer /* inner } */ still */\nfn c<'x>(s: &'x str) { let _ = \"}\\\"{\"; }\n", [
        (1, "function", "a@n", "", "fn a@n() -> char", "", "{ '{' }"), (2, "function", "b", "", "fn b() -> &'static str", "", "{ r#\"} \" fn fake() {\"# }"),
        (4, "function", "c", "", "fn c<'x>(s: &'x str)", "outer /* inner } */ still", "{ let _ = \"}\\\"{\"; }")]),
    ("macros", "macro_rules! m { ($x:expr) => { fn fake() {} }; }\nthread_local! { static X: u8 = 1; }\nmod inner { pub fn hidden() {} }\nextern \"C\" { fn c_side(); }\npub extern \"C\" fn shown@n() {}\n", [
        (5, "function", "shown@n", "", "pub extern \"C\" fn shown@n()", "", "{}")]),
    ("impls", "/// Impl docs.\nimpl Store@n {\n    pub const MAX: usize = @z;\n    /// Get docs.\n    pub async fn get(&self) -> u8 {\n        1\n    }\n    type X = u8;\n}\n", [
        (5, "method", "get", "Store@n", "pub async fn get(&self) -> u8", "Impl docs.\nGet docs.", "{\n        1\n    }")]),
    ("head", "pub fn long@n<T>(\n    a: T,\n    b: u8,\n) -> Result<T, E>\nwhere\n    T: Clone,\n{\n    Ok(a)\n}\n", [
        (1, "function", "long@n", "", "pub fn long@n<T>(\n    a: T,\n    b: u8,\n) -> Result<T, E>", "", "{\n    Ok(a)\n}")]),
    ("broken", "// @search: entry @n\nfn a() { \"open }\n", [(1, "annotation", "annotation:1", "", "", "entry @n", "fn a() { \"open }")]),
]
TYPESCRIPT = [
    ("regex", "function a@n(s) { return /[{(]/.test(s) }\nif (s) /[{]/.exec(s)\nfunction b(x) { return x / 2 / y }\nconst re = /\\/[/{]+/g, half = n / 2\n", [
        (1, "function", "a@n", "", "function a@n(s)", "", "{ return /[{(]/.test(s) }"), (3, "function", "b", "", "function b(x)", "", "{ return x / 2 / y }"),
        (4, "constant", "re", "", "re = /\\/[/{]+/g", "", "/\\/[/{]+/g"), (4, "constant", "half", "", "half = n / 2", "", "n / 2")]),
    ("template", "const t@n = `a ${ `b {` } c`\nexport function after() { return `${ { a: `}` }.a }` }\nlet last = 1 // end\n", [
        (1, "constant", "t@n", "", "t@n = `a ${ `b {` } c`", "", "`a ${ `b {` } c`"), (2, "function", "after", "", "function after()", "", "{ return `${ { a: `}` }.a }` }"),
        (3, "variable", "last", "", "last = 1", "end", "1")]),
    ("oneline", "interface I@n { m(): void; n?(x: string): number, p: () => void }\nexport class C { constructor() {} static get x() { return 1 } #y() {} z = () => { return 2 } }\nenum E { A, B } const enum F { C }\n", [
        (1, "interface", "I@n", "", "interface I@n", "", "{ m(): void; n?(x: string): number, p: () => void }"), (1, "method", "m", "I@n", "m(): void", "", ""), (1, "method", "n", "I@n", "n?(x: string): number", "", ""),
        (2, "class", "C", "", "class C", "", "{ constructor() {} static get x() { return 1 } #y() {} z = () => { return 2 } }"), (2, "method", "x", "C", "static get x()", "", "{ return 1 }"),
        (2, "method", "#y", "C", "#y()", "", "{}"), (3, "enum", "E", "", "enum E", "", "{ A, B }"), (3, "enum", "F", "", "const enum F", "", "{ C }")]),
    ("types", "export type Shape@n<T> = { kind: T } | null;\nexport function pick<T extends { a: 1 }>(x: T): { a: T } {\n  return { a: x }\n}\nexport abstract class Base<T = {}> extends Other<{ b: T }> implements I {\n  abstract todo(): void\n  done(): { x: T } { return null }\n}\n", [
        (1, "type", "Shape@n", "", "type Shape@n<T> = { kind: T } | null;", "", ""), (2, "function", "pick", "", "function pick<T extends { a: 1 }>(x: T): { a: T }", "", "{\n  return { a: x }\n}"),
        (5, "class", "Base", "", "abstract class Base<T = {}> extends Other<{ b: T }> implements I", "", "{\n  abstract todo(): void\n  done(): { x: T } { return null }\n}"),
        (7, "method", "done", "Base", "done(): { x: T }", "", "{ return null }")]),
    ("arrows", "export const parse@n = (v: string): number => v.length\nconst run = async () => {\n  await x\n}\nconst map = new Map<string, number>(), fn = function* () { yield 1 }\nvar K = class { m() {} }\nconst { a, b } = obj\n", [
        (1, "function", "parse@n", "", "parse@n = (v: string): number => v.length", "", "v.length"), (2, "function", "run", "", "run = async () => {\n  await x", "", "{\n  await x\n}"),
        (5, "constant", "map", "", "map = new Map<string, number>()", "", "new Map<string, number>()"), (5, "function", "fn", "", "fn = function* () { yield 1 }", "", "{ yield 1 }"),
        (6, "class", "K", "", "K = class { m() {} }", "", "{ m() {} }"), (7, "constant", "{ a, b }", "", "{ a, b } = obj", "", "obj")]),
    ("docs", "/** First @n. */\n// Second.\nexport default class A {\n  // Far.\n\n  // Near.\n  @dec({ x: 1 })\n  m() {}\n  /** Own. */\n  static async *gen<T>(x: T) {} // behind\n}\n", [
        (3, "class", "A", "", "class A", "First @n.\nSecond.", "{\n  // Far.\n\n  // Near.\n  @dec({ x: 1 })\n  m() {}\n  /** Own. */\n  static async *gen<T>(x: T) {} // behind\n}"),
        (8, "method", "m", "A", "m()", "", "{}"), (10, "method", "gen", "A", "static async *gen<T>(x: T)", "Own.\nbehind", "{}")]),
    ("overloads", "export function f@n(a: string): void;\nexport function f@n(a: number): void {\n}\nexport { x } from 'y'\nexport * from \"z\"\nimport q from 'q'\n", [
        (1, "function", "f@n", "", "function f@n(a: string): void;", "", ""), (2, "function", "f@n", "", "function f@n(a: number): void", "", "{\n}")]),
    ("nosemi", "const a@n = 1\nconst b = a@n +\n  2\nconst c = list\n  .map(x => x)\n  .filter(Boolean)\nfunction d() {}\nfoo()\n", [
        (1, "constant", "a@n", "", "a@n = 1", "", "1"), (2, "constant", "b", "", "b = a@n +\n  2", "", "a@n +\n  2"), (4, "constant", "c", "", "c = list\n  .map(x => x)\n  .filter(Boolean)", "", "list\n  .map(x => x)\n  .filter(Boolean)"),
        (7, "function", "d", "", "function d()", "", "{}")]),
    ("crlf", "/* Doc\r\n * @n. */\r\nexport interface S {\r\n  get(id: string): string\r\n}\r\n", [
        (3, "interface", "S", "", "interface S", "Doc\n@n.", "{\n  get(id: string): string\n}"), (4, "method", "get", "S", "get(id: string): string", "", "")]),
    ("broken", "// @search: entry @n\nfunction a() { return `open }\n", [(1, "annotation", "annotation:1", "", "", "entry @n", "function a() { return `open }")]),
]
#: Folder, suffix and shapes of each language.
SHAPES = [("go", ".go", GO), ("py", ".py", PYTHON), ("rs", ".rs", RUST), ("ts", ".ts", TYPESCRIPT)]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def literal(text: str, newline: str) -> str:
    """``text`` as SQL; line ends are spelled by ``newline``, backslashes by their code."""
    out = quoted(text)
    for char, code in (("\\", 92), ("\n", 10), ("\r", 13), ("\t", 9)):
        out = out.replace(char, f"' || {newline.format(code)} || '")
    return out


def filled(text: str) -> str:
    return f"replace(replace(replace({text}, '@n', CAST(p_partkey AS string)), '@z', CAST(p_size AS string)), '@t', p_name)"


def files_sql() -> str:
    """One file per part and shape; ``{part}`` is to be filled in."""
    rows = [f"({quoted(f'{folder}/{name}')}, {quoted(suffix)}, {literal(text, 'chr({})')})" for folder, suffix, shapes in SHAPES for name, text, _ in shapes]
    values = ", ".join(rows).replace("{", "{{").replace("}", "}}")
    return f"SELECT concat(name, '_', CAST(p_partkey AS string), suffix) AS path, {filled('template')} AS content FROM {{part}} CROSS JOIN (VALUES {values}) AS t(name, suffix, template)"


def symbols_sql() -> str:
    """The symbols of those files."""
    rows = [f"({quoted(f'{folder}/{name}')}, {quoted(suffix)}, {line}, {', '.join(literal(x, 'chr({})') for x in [*rest, *([''] * (7 - len(rest)))])})"
            for folder, suffix, shapes in SHAPES for name, _, symbols in shapes for line, *rest in symbols]
    columns = ["kind", "name", "container", "signature", "documentation", "body", "file_context"]
    each = ", ".join(f"{filled(f't.{c}')} AS {c}" for c in columns)
    return (f"SELECT path, line, kind, name, container, CASE WHEN container = '' THEN name ELSE concat(container, '.', name) END AS qualified_name, signature, documentation, md5(body) AS body, file_context FROM ("
            f"SELECT concat(t.file, '_', CAST(p_partkey AS string), suffix) AS path, CAST(line AS int) AS line, {each} FROM part CROSS JOIN (VALUES {', '.join(rows)}) AS t(file, suffix, line, {', '.join(columns)}))")


def verdicts_sql() -> str:
    """The extractor of each of those files."""
    rows = [f"({quoted(f'{folder}/{name}')}, {quoted(suffix)}, {quoted('annotations' if name == 'broken' else 'declarations')})" for folder, suffix, shapes in SHAPES for name, _, _ in shapes]
    return f"SELECT concat(t.file, '_', CAST(p_partkey AS string), suffix) AS path, extractor FROM part CROSS JOIN (VALUES {', '.join(rows)}) AS t(file, suffix, extractor)"
