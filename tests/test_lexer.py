"""Definitions and imports of sources in each language: nesting, braces in strings and comments, broken sources."""

import time

import pytest

from loomspan.functions import lexer
from loomspan.operators import chunks

SOURCES = {
    "javascript": r"""import React, { useState } from 'react';
import './a.css'
const s = "function no() { {", r = /[}{]\/function x(){/g;
// class Nope {
/* function nope() { */
export default class App extends Base {
  static x = 1
  constructor(a) { super(a) }
  async render({ a, b } = {}) {
    if (a) { return `t ${a ? `{${b}}` : "}"} class Z {` }
    return items.map(x => x + 1).filter((y) => { return y > 2 })
  }
  get size() { return 1 }
}
async function load(url, opts = { a: 1 }) {
  const f = async (u) => { await u }
  return f
}
const o = { go() { return 1 }, arrow: z => z, k: function () { return 2 } }
let q = class { inner() {} }
function* gen() { yield 1 }
""",
    "typescript": r"""import type { A } from '@scope/pkg/deep'
interface I { f(): void }
export abstract class Q<T> extends R<T> { private readonly n: number = 1; public go<U>(x: U, y?: string): Promise<Map<string, U>> { return null } }
export class Plain { m = (a: number): number => a * 2
  other(): void {} }
export const fn = (a: string): string => { return a }
enum E { A, B }
function over(a: { b: string }): a is X { return true }
""",
    "java": r"""package a.b;
import java.util.List;
import static org.x.Y.z;
@Anno(x = {1, 2})
public final class Main<T extends Foo> extends B implements C {
  private int[] a = {1, 2};
  static { init(); }
  public Main(int x) { this.x = x; }
  @Override
  public <U> List<U> get(String s, Map<String, Integer> m) throws IOException { if (s.equals("{")) { return null; } char c = '{'; return run(() -> { go(); }); }
  abstract void none();
  class Inner { void deep() { new Runnable() { public void run() { } }; } }
  interface J { int f(int x); default int g() { return 1; } }
  enum K { A { int z() { return 1; } }, B; int y() { return 2; } }
}
""",
    "go": r"""package main
import "fmt"
import (
	"os"
	x "net/http"
)
type P struct {
	a int // }
	f func(x int) int
}
type ID = string
type (
	A int
	B struct{ c int }
)
func (p *P) Get(x int) (int, error) {
	s := `{ func no() {`
	g := func() { fmt.Println("}") }
	if x > 1 { g() } else { return 1, nil }
	return struct{ a int }{1}.a, nil
}
func main() { for i := 0; i < 3; i++ { fmt.Println('{') } }
""",
    "rust": r"""use std::collections::HashMap;
use crate::x;
use serde::{Serialize, Deserialize};
#[derive(Debug)]
pub struct S<'a> { x: &'a str, c: char }
struct T(i32, i32);
struct U;
enum E { A { x: i32 }, B }
/* a /* nested { */ } */
impl<'a> S<'a> {
    pub(crate) async unsafe fn go<T: Fn(i32) -> i32>(&self, f: T) -> Result<(), String> where T: Clone { let c = '{'; let s = r#"fn no() {"#; match f { _ => { } } Ok(()) }
}
pub trait Tr { fn sig(&self); fn dflt(&self) -> i32 { 1 } }
mod m { pub fn inner() {} }
fn main() { let v = S { x: "}", c: '\'' }; let f = |x| { x }; }
""",
    "php": r"""<html> class Nope { <?php
namespace A;
use Foo\Bar\Baz;
use function X\y;
# class Nope {
abstract class K extends L { use Tr; const A = 1; private $x = ['{' => 1];
  public function __construct(private int $a) { parent::__construct(); }
  abstract protected function none(int $x): ?string;
  public static function go(array $x = []): int { $f = function ($y) use ($x) { return "}{$y}"; }; $g = fn($z) => $z + 1; return <<<EOT
function no() { {
EOT; }
}
function top() { if (1) { return 2; } }
interface I { function f(); }
?> function html() { <?php function after() {} ?>
""",
}
#: Kind, first and last line, how the text begins, how it ends.
DEFINITIONS = {
    "javascript": [
        ("class", 6, 14, 'class App extends Base {', 'return 1 }\n}'),
        ("function", 8, 8, 'constructor(a) { super(a', '{ super(a) }'),
        ("function", 9, 12, 'async render({ a, b } = ', 'y > 2 })\n  }'),
        ("function", 11, 11, 'x => x + 1', 'x => x + 1'),
        ("function", 11, 11, '(y) => { return y > 2 }', 'turn y > 2 }'),
        ("function", 13, 13, 'get size() { return 1 }', '{ return 1 }'),
        ("function", 15, 18, 'async function load(url,', '  return f\n}'),
        ("function", 16, 16, 'async (u) => { await u }', ' { await u }'),
        ("function", 19, 19, 'go() { return 1 }', '{ return 1 }'),
        ("function", 19, 19, 'z => z', 'z => z'),
        ("function", 20, 20, 'inner() {}', 'inner() {}'),
    ],
    "typescript": [
        ("function", 3, 3, 'public go<U>(x: U, y?: s', 'eturn null }'),
        ("class", 4, 5, 'class Plain { m = (a: nu', '): void {} }'),
        ("function", 4, 4, '(a: number): number => a', 'ber => a * 2'),
        ("function", 5, 5, 'other(): void {}', 'r(): void {}'),
        ("function", 6, 6, '(a: string): string => {', '{ return a }'),
        ("function", 8, 8, 'function over(a: { b: st', 'eturn true }'),
    ],
    "java": [
        ("class", 4, 15, '@Anno(x = {1, 2})\npublic', 'urn 2; } }\n}'),
        ("function", 9, 10, '@Override\n  public <U> L', ' go(); }); }'),
        ("function", 11, 11, 'abstract void none();', 'void none();'),
        ("class", 12, 12, 'class Inner { void deep(', ') { } }; } }'),
        ("function", 12, 12, 'void deep() { new Runnab', 'n() { } }; }'),
        ("function", 12, 12, 'public void run() { }', 'id run() { }'),
        ("function", 13, 13, 'int f(int x);', 'nt f(int x);'),
        ("function", 13, 13, 'default int g() { return', ' return 1; }'),
        ("function", 14, 14, 'int z() { return 1; }', ' return 1; }'),
        ("function", 14, 14, 'int y() { return 2; }', ' return 2; }'),
    ],
    "go": [
        ("class", 7, 10, 'type P struct {\n\ta int /', 'x int) int\n}'),
        ("class", 11, 11, 'type ID = string', ' ID = string'),
        ("class", 12, 15, 'type (\n\tA int\n\tB struct{', 't{ c int }\n)'),
        ("function", 16, 21, 'func (p *P) Get(x int) (', '{1}.a, nil\n}'),
        ("function", 22, 22, 'func main() { for i := 0', "tln('{') } }"),
    ],
    "rust": [
        ("class", 5, 5, "pub struct S<'a> { x: &'", 'r, c: char }'),
        ("class", 6, 6, 'struct T(i32, i32);', 'T(i32, i32);'),
        ("class", 7, 7, 'struct U;', 'struct U;'),
        ("class", 8, 8, 'enum E { A { x: i32 }, B', ': i32 }, B }'),
        ("class", 10, 12, "impl<'a> S<'a> {\n    pub", '} Ok(()) }\n}'),
        ("function", 11, 11, 'pub(crate) async unsafe ', '} } Ok(()) }'),
        ("function", 13, 13, 'fn dflt(&self) -> i32 { ', '-> i32 { 1 }'),
        ("function", 14, 14, 'pub fn inner() {}', 'n inner() {}'),
        ("function", 15, 15, 'fn main() { let v = S { ', '|x| { x }; }'),
    ],
    "php": [
        ("class", 6, 12, 'abstract class K extends', '{ {\nEOT; }\n}'),
        ("function", 7, 7, 'public function __constr', 'nstruct(); }'),
        ("function", 8, 8, 'abstract protected funct', 'x): ?string;'),
        ("function", 9, 11, 'public static function g', ') { {\nEOT; }'),
        ("function", 9, 9, 'fn($z) => $z + 1', 'z) => $z + 1'),
        ("function", 13, 13, 'function top() { if (1) ', 'eturn 2; } }'),
        ("function", 14, 14, 'function f();', 'unction f();'),
        ("function", 15, 15, 'function after() {}', 'n after() {}'),
    ],
}
IMPORTS = {
    "javascript": ["react", "."],
    "typescript": ["@scope/pkg"],
    "java": ["java.util", "org.x.Y"],
    "go": ["fmt", "os", "net"],
    "rust": ["std", "serde"],
    "php": ["Foo", "X"],
}


@pytest.mark.parametrize("language", SOURCES)
def test_definitions_have_exact_spans(language):
    source = SOURCES[language]
    got = [(kind, source.count("\n", 0, a) + 1, source.count("\n", 0, b) + 1, source[a:b][:24], source[a:b][-12:]) for a, b, kind in lexer.definitions(source, language)]
    assert got == DEFINITIONS[language]
    rows = chunks.cut(source, "f", language)
    assert [(r[2], r[4], r[5]) for r in rows] == [x[:3] for x in got] and all(r[1] in source for r in rows)
    assert chunks.import_names(source, language) == IMPORTS[language]


@pytest.mark.parametrize("language", SOURCES)
def test_broken_sources_are_read_to_the_end(language):
    source = SOURCES[language]
    for cut in range(0, len(source), 7):
        assert all(0 <= a < b <= cut for a, b, _ in lexer.definitions(source[:cut], language))
        assert all(0 <= a < b <= len(source) - cut for a, b, _ in lexer.definitions(source[cut:], language))
        chunks.import_names(source[:cut], language)


@pytest.mark.parametrize("language", SOURCES)
@pytest.mark.parametrize("part", ["{", "}", "(", "a ", "'", '"', "`${", "/*", "=> ", "< ", "a(b) {", "\\", "#", "r#", "fn f", ", x => "])
def test_long_sources_take_linear_time(language, part):
    began = time.perf_counter()
    lexer.definitions(part * 20_000, language)
    lexer.imports(part * 20_000, language)
    assert time.perf_counter() - began < 10


def test_python_by_tree_and_by_indentation():
    source = "class A:\n    def f(self):\n        return 'é'\n\n    @wrap\n    async def g(self): pass\n\n\ndef h(\n    a,\n):\n    '''\ndef no():\n'''\n    return 1\n"
    whole = [(r[2], r[4], r[5], r[1][:9]) for r in chunks.cut(source, "a.py", "python")]
    assert whole == [("class", 1, 6, "class A:\n"), ("function", 2, 3, "def f(sel"), ("function", 6, 6, "async def"), ("function", 9, 15, "def h(\n  ")]
    assert [(r[2], r[4], r[5], r[1][:9]) for r in chunks.cut(source + "x = (\n", "a.py", "python")] == whole
    text = "import a, b.c as d\nfrom . import x, y\nfrom .z import q\nfrom m.n import (p,\n q)\nfrom k import *\n"
    assert chunks.import_names(text, "python") == chunks.import_names(text + "def (:\n", "python") == ["a", "b", "x", "y", "z", "m", "k"]


def test_python_names_after_dots_in_broken_sources():
    from loomspan.operators.chunks import import_names

    assert import_names("import ...and.more, .x\nfrom web.base import x\n", "python") == ["and", "x", "web"]
