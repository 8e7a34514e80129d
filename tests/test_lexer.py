"""Definitions of brace languages with braces in strings and comments."""

import time

from spanloom.operators.lexer import code_only
from spanloom.operators.syntax import brace_definitions, syntax_chunks

RUST = """// fn no() {
/* outer /* { */ still */
pub struct A { x: i32 }
impl<T> Foo<T> for Bar {
    fn go<'a>(&'a self) -> [u8; 3] {
        let s = "}"; let r = r#"{ " }"#; let c = '{'; let d = '\\'';
        [1, 2, 3]
    }
    fn short();
}
type X = Vec<u8>;
macro_rules! mac {
    () => {};
}
fn last() {}
"""
SCRIPT = """export class Page {
  // opens { here
  run({a, b}) {
    const s = "}"; if (x) { y(); }
    return `a ${ {k: "}"}.k + `n${1}` } }`;
  }
  get size() { return /[}]{2}\\//.test(this.s) / 2; }
}
const f = (a) => {
  return a / 2 / 3;
}
let g = 1
type T = { a: string }
interface I { b(): void }
function after() { return '{' }
var z = [1,
  2]
"""
GO = """package x
type P struct {
\tA int
}
type Q int
func (p *P) Go(a int,
\tb int) error {
\ts := `}` + "{" + string('}')
\treturn nil
}
const C = 1 +
\t2
var (
\ta = 1
)
"""


def test_rust():
    assert brace_definitions(RUST, "rust") == [
        (3, 3, "struct", "A", 0), (4, 10, "impl", "Bar", 0), (5, 8, "function", "go", 1), (9, 9, "function", "short", 1),
        (11, 11, "type", "X", 0), (12, 14, "macro", "mac", 0), (15, 15, "function", "last", 0)]


def test_script():
    assert brace_definitions(SCRIPT, "typescript") == [
        (1, 8, "class", "Page", 0), (3, 6, "method", "run", 1), (7, 7, "method", "size", 1), (9, 11, "const", "f", 0), (12, 12, "const", "g", 0),
        (13, 13, "type", "T", 0), (14, 14, "interface", "I", 0), (15, 15, "function", "after", 0), (16, 17, "const", "z", 0)]


def test_go():
    assert brace_definitions(GO, "go") == [
        (2, 4, "type", "P", 0), (5, 5, "type", "Q", 0), (6, 10, "function", "Go", 0), (11, 12, "const", "C", 0)]


def test_what_is_not_code_is_blank():
    for text, language in ((RUST, "rust"), (SCRIPT, "typescript"), (GO, "go")):
        code = code_only(text, language)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert all(a == b or a == " " for a, b in zip(code, text)) and code.count("{") == code.count("}")


def test_errors_give_line_windows():
    for text, language in (("fn a( {", "rust"), ('let s = "abc', "javascript"), ("fn a() { /* }", "rust"), ("x = `a ${b`", "tsx"), ("func a() { s := `x }", "go")):
        assert brace_definitions(text, language) is None
        assert [kind for _, _, kind, _ in syntax_chunks(text, language)] == ["line_window"]


def test_linear_time():
    start = time.perf_counter()
    assert len(brace_definitions("fn f() {\n" * 20_000 + "}\n" * 20_000, "rust")) == 20_000
    assert len(brace_definitions(SCRIPT * 2_000, "typescript")) == 18_000
    brace_definitions("a/b;" * 200_000, "javascript")
    brace_definitions("fn " * 100_000 + "impl " * 100_000, "rust")
    assert time.perf_counter() - start < 20
