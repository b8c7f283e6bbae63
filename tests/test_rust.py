"""Rust sources: tokens, owners, predicates, lines, modules."""

import random

import pytest

from linefacts.functions.rustlex import Context, RustError, Source, counts, tokens, unconfigured_counts
from linefacts.operators import rust

PROD, TEST = Context(frozenset()), Context(frozenset({"test"}), True)
BOTH = [PROD, TEST]


def owned(text):
    return [text[g.start : g.end] for g in Source(text).groups]


@pytest.mark.parametrize(
    ("text", "first"),
    [
        ("mod m { #![cfg(a)] fn f() {} }", "mod m { #![cfg(a)] fn f() {} }"),
        ("struct S { #[cfg(a)] x: u8, y: u8 }", "#[cfg(a)] x: u8,"),
        ("struct S(#[cfg(a)] u8, u8);", "#[cfg(a)] u8,"),
        ("enum E { #[cfg(a)] V { x: u8 }, W }", "#[cfg(a)] V { x: u8 },"),
        ("fn f<#[cfg(a)] T: Into<Vec<u8>>, U>() {}", "#[cfg(a)] T: Into<Vec<u8>>,"),
        ("fn f(#[cfg(a)] x: u8, y: u8) {}", "#[cfg(a)] x: u8,"),
        ("fn f() { #[cfg(a)] let x = S { y: 1 }; g(); }", "#[cfg(a)] let x = S { y: 1 };"),
        ("fn f() { #[cfg(a)] if x { 1 } else { 2 } g() }", "#[cfg(a)] if x { 1 } else { 2 }"),
        ("fn f() { match v { #[cfg(a)] 0 | 1 => g(), _ => {} } }", "#[cfg(a)] 0 | 1 => g(),"),
        ("fn f() { #[cfg(a)] println!(\"}\"); }", "#[cfg(a)] println!(\"}\");"),
        ("#[cfg(a)] use x::{y, z}; fn f() {}", "#[cfg(a)] use x::{y, z};"),
        ("#[cfg(a)] impl<T> X for Y<T> where T: Z { fn f() {} } fn g() {}", "#[cfg(a)] impl<T> X for Y<T> where T: Z { fn f() {} }"),
        ("#[cfg(a)] pub(crate) const fn f() -> [u8; 2] { [0; 2] } fn g() {}", "#[cfg(a)] pub(crate) const fn f() -> [u8; 2] { [0; 2] }"),
        ("#[cfg(a)] extern \"C\" { fn f(); } fn g() {}", "#[cfg(a)] extern \"C\" { fn f(); }"),
        ("fn f() { let x = S { #[cfg(a)] y: 1, z: 2 }; }", "#[cfg(a)] y: 1,"),
    ],
)
def test_owner(text, first):
    assert owned(text)[0] == first


def test_macro_input_is_opaque():
    assert owned("m! { #[cfg(a)] fn f() {} } macro_rules! n { () => { #[cfg(a)] fn f() {} }; }") == []


@pytest.mark.parametrize("text", ["fn f( {}", "\"open", "/* open", "r#\"open\"", "fn f() }"])
def test_malformed(text):
    with pytest.raises(RustError):
        Source(text)


def test_tokens_cover_everything_but_white_space():
    text = "#!/bin/x\nlet a = 'b'; let c: &'static str = r##\"x\"#\"##; /* /* */ */ b'\\'' 1.5e3 r#fn // end"
    at = 0
    for t in tokens(text):
        assert not text[at : t.start].strip()
        at = t.end
    assert [t.text for t in tokens("'a 'b' '\\n'")] == ["'a", "'b'", "'\\n'"]


def test_blank_lines_in_inactive_regions_do_not_count():
    assert counts([("#[cfg(any())]\nmod m {\n\n}\n\nfn f() {}\n", BOTH)]) == (1, 2, 1, 0, 1, 0)


def test_production_wins_over_test():
    assert counts([("#[cfg(test)]\nfn t() {} fn u() {}\n", BOTH)]) == (1, 2, 0, 0, 1, 1)


def test_harness_free_targets_do_not_set_test():
    c = Context(frozenset(), True, False)
    assert counts([("fn main() {}\n#[test]\nfn t() {}\n", [c])]) == (1, 1, 0, 0, 0, 1)


def test_conditional_attributes_nest():
    assert counts([("#[cfg_attr(all(), cfg_attr(not(test), cfg(any())))]\nfn f() {}\n", BOTH)]) == (1, 2, 0, 0, 0, 2)


def test_malformed_predicates_raise_unless_inactive():
    with pytest.raises(RustError):
        counts([("#[cfg(not(a, b))]\nfn f() {}\n", BOTH)])
    assert counts([("#[cfg(any())]\nmod m {\n#[cfg(not(a, b))]\nfn f() {}\n}\n", BOTH)])[1] == 0


def test_unconfigured_counts_all():
    assert unconfigured_counts("#[cfg(any())]\nfn f() {}\n\n// c\n") == (1, 4, 1, 1, 2)


def test_random_items_account_for_every_line():
    r = random.Random(8)
    for _ in range(40):
        text, lines = "", 0
        for _ in range(r.randint(1, 12)):
            kind = r.choice(["fn f() {}\n", "// c\n", "\n", "struct S { x: u8 }\n", "static X: u8 = 1;\n"])
            text += kind
            lines += 1
        f, n, blank, comment, code, test = counts([(text, BOTH)])
        assert (f, n, blank + comment + code, test) == (1, lines, lines, 0)


@pytest.mark.parametrize("bad", ["let x = 1;", "fn () {}", "struct { a: u8 }", "use a::b", "mod m", "const A: u8 = 1", "1 + 1;", "mod m { if x {} }", "fn f() {}\n;", "static S: u8 = { 1 }", "\"text\";", "mod m { fn g() {} } }", "pub fn f( {}"])
def test_malformed_items_raise(bad):
    with pytest.raises(RustError):
        Source(bad)


def test_well_formed_items_pass():
    Source("#!/usr/bin/env x\n#![allow(x)]\npub(crate) use a::{b, c as d};\nextern crate e;\nconst fn f() {}\nconst _: () = { assert!(true); };\npub unsafe extern \"C\" fn g() {}\nextern \"C\" { fn h(); }\nunsafe impl Send for T {}\ntype T<'a> = &'a dyn Fn() -> u8;\nstatic mut S: [u8; 2] = [1; 2];\nthread_local! { static X: u8 = 1 }\ncrate::m!(a, b);\n::std::println!();\nmacro_rules! n { () => {} }\nunion U { a: u8 }\nasync fn k() {}\nauto trait A {}\npub macro q() {}\nimpl<T> Tr for T where T: Copy { const C: u8 = 1; type Y = T; fn z() { let x = if a { 1 } else { 2 }; } }\nenum E { A = 1, B { x: u8 }, C(u8) }\npub struct P<const N: usize>([u8; N]) where [u8; N]: Sized;\nmod m { #![cfg(all())] pub(super) fn i() {} }\n")


def test_contexts_at_once_agree_with_each_alone():
    import random

    r = random.Random(3)

    def predicate(d):
        k = r.choice(["o", "o", "all", "any", "not", "kv", "true"] if d else ["o", "kv"])
        return {"o": lambda: r.choice("abc"), "kv": lambda: f'feature = "{r.choice("xy")}"', "true": lambda: r.choice(["true", "false"]), "not": lambda: f"not({predicate(d - 1)})"}.get(k, lambda: f"{k}({', '.join(predicate(d - 1) for _ in range(r.randrange(3)))})")()

    def attribute(d=2):
        k = r.choice(["cfg", "cfg", "test", "attr"] if d else ["cfg"])
        return f"cfg({predicate(2)})" if k == "cfg" else "test" if k == "test" else f"cfg_attr({predicate(2)}, {', '.join(attribute(d - 1) for _ in range(r.randrange(1, 3)))})"

    contexts = [Context(frozenset(o for o in ("a", "b", "c", ("feature", "x"), ("feature", "y")) if r.random() < 0.5), r.random() < 0.5, r.random() < 0.7) for _ in range(9)]
    for _ in range(150):
        body = "".join("".join(f"#[{attribute()}]\n" for _ in range(r.randrange(3))) + f"mod m{i} {{\n#[{attribute()}]\nfn f() {{}}\n}}\n" for i in range(3))
        s = Source(body)
        assert s.inactive_in(contexts) == [s.inactive(c) for c in contexts]


def test_module_paths():
    text = "mod r#a; mod i { #[path = \"x.rs\"] mod p; mod q; } #[cfg_attr(all(), path = \"y/z.rs\")] mod s;"
    got = rust.declared_modules(text, "src/lib.rs", "src", PROD)
    assert got == [("a", "src", None), ("p", "src/i", "src/i/x.rs"), ("q", "src/i", None), ("s", "src", "src/y/z.rs")]
    known = frozenset({"unix", "feature"}), frozenset({("target_os", "linux")}), frozenset({"f"})
    text = "#[cfg(all(foo, unix, feature = \"f\", feature = \"g\"))] fn f() { #[cfg(never)] fn g() {} } #[cfg_attr(any(), cfg(no))] #[cfg(not(target_os = \"plan9\"))] fn h() {}"
    assert rust.unknown_options(text, [PROD], *known) == {"foo", 'feature = "g"', 'target_os = "plan9"'}


def test_missing_and_ambiguous_modules_raise(spark):
    for files in ([("lib.rs", "mod a;")], [("lib.rs", "mod a;"), ("a.rs", ""), ("a/mod.rs", "")]):
        tree = spark.createDataFrame(files, "path string, text string")
        roots = spark.createDataFrame([("lib.rs", 0, [], False, True)], "path string, ctx_id int, options array<string>, test boolean, harness boolean")
        with pytest.raises(Exception, match="module a"):
            rust.reachable_files(tree, roots).count()
