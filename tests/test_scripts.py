"""Breaks of scripts lie before declarations at the top level only."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesift.operators.chunking import CLASS, FUNCTION, IMPORT, chunk, code_breaks
from lakesift.operators.scripts import declarations

CASES = {
    "plain": ("import a from 'a';\nclass A {}\nfunction f() {}\nasync function g() {}\nexport const x = 1;\n", ["class A", "function f", "async function", "export const"]),
    "template string": ("const t = `\nexport const no = 1\nclass No {\n`;\nclass Yes {}\n", ["class Yes"]),
    "template with code": ("const t = `a ${ {b: `\nclass No`}.b } \nfunction no() {}`;\nfunction yes() {}\n", ["function yes"]),
    "comments": ("/*\nclass No {}\n*/\n// {\nclass Yes {}\n/* x */ function yes() {}\n", ["class Yes", "/* x */ function yes"]),
    "strings": ("const s = '{';\nconst q = \"`\";\nconst e = '\\'{';\nclass Yes {}\n", ["class Yes"]),
    "inside brackets": ("const o = {\nclass: 1,\nf() {\n}\n};\ndescribe('x', () => {\nfunction no() {}\nclass No {}\n});\nfunction yes() {}\n", ["function yes"]),
    "patterns": ("const r = /[`/{]'/g;\nconst s = x.replace(/\"{/, '');\nfunction yes(a) { return /}/.test(a) }\nconst d = a / b; // {\nclass Yes {}\n", ["function yes", "class Yes"]),
    "expressions": ("const f =\nfunction () {};\nconst C =\nclass {};\nimport('x').then(y);\nimport.meta.url;\nexports = 1;\nclassy();\nfunctional();\n", []),
    "decorators": ("let a;\n@Component({\n  x: 1\n})\nexport class A {\n  @Input() b;\n}\n@f\nclass B {}\n", ["@Component", "@f"]),
    "typescript": ("import type { A } from './a';\nimport b = require('b');\ninterface I {\n}\nexport interface J { a: string }\nexport default class<T> {}\nfunction g<T extends object>(a: T): a is T {\n}\n", ["import b", "export interface", "export default", "function g"]),
    "unclosed": ("class A {}\nfunction f() {\nclass No {}\nfunction no() {}", ["function f"]),
    "imports": ("'use strict';\nimport {\n  a,\n} from 'a';\nimport 'b';\nimport{c} from 'c';\n", ["import {", "import 'b'", "import{c}"]),
    "indented": ("let a;\n  class A {}\n\tfunction f() {}\n", ["  class A", "\tfunction f"]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    code, wanted = CASES[name]
    found = [at + 1 for at, _ in code_breaks("typescript", code)]
    assert len(found) == len(wanted) and all(code.startswith(w, at) for at, w in zip(found, wanted, strict=True)), [code[a:a + 20] for a in found]
    assert all(code[at - 1] == "\n" for at in found)


def test_weights():
    code = "let x;\nimport a from 'a';\nclass A {}\nexport class B {}\n"
    assert [w for _, w in code_breaks("javascript", code)] == [IMPORT, CLASS, FUNCTION]
    assert not list(code_breaks("java", code)) and not list(code_breaks("javascript", ""))


def test_cuts_of_a_fence():
    lines = "".join(f"  call({k});\n" for k in range(12))
    text = f"# Code\n\n```typescript\nfunction one() {{\n{lines}}}\nfunction two() {{\n{lines}}}\n```\n"
    ends = {pos + n for pos, n, *_ in chunk(text, 300, 0, 1)}
    assert text.index("\nfunction two") in ends


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="`${}()'\"/\\*\n @aclsexportfunimd", max_size=200))
def test_any_text_ends_at_lines_in_order(code):
    found = [at for at, _ in declarations(code)]
    assert found == sorted(set(found)) and all(not at or code[at - 1] == "\n" for at in found)


def test_long_scripts_take_time_by_length():
    start = time.time()
    assert len(list(declarations("function f(a) { return `${a}` / 2 }\n" * 20_000))) == 20_000
    assert list(declarations("`${" * 20_000)) == [] and list(declarations("/" * 50_000)) == []
    assert time.time() - start < 20
