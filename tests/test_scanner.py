import random

from typeharvest.functions.scanner import code_of


def test_code_of():
    cases = {
        'a # b\nc': 'a    \nc',
        '#= #= =# f(x) =#\ng': ' ' * 16 + '\ng',
        '#= a #= b =#': '"           ',
        's = "$(a(b("k # z")))"; h': 's = ""(a(b("k # z"))) ; h',
        '"$(T >: Int)"': '""(T >: Int) ',
        '"a $(x) b $(y) c" * d': '""  (x)    (y)    * d',
        "x = '#'; y' # t": "x = '#'; y'    ",
        'r"a$(b" # c': 'r"    "    ',
        '"""a "b" c""" # d': '"""       """    ',
        '`ls $(f("#"))` # e': '""   (f("#"))',
        '"open': '"    ',
        '"a $(b': '""  (b',
        '"\\"#" # x': '"\\"#"    ',
        "": "",
    }
    for text, want in cases.items():
        got = code_of(text)
        assert len(got) == len(text), (text, got)
        assert got.rstrip() == want.rstrip(), (text, got)


def test_lengths_and_depth():
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(['"', '"""', "`", "#", "#=", "=#", "$(", ")", "(", "\n", "a", "\\", "'", "é"]) for _ in range(rnd.randint(0, 25)))
        assert len(code_of(text)) == len(text), text
    deep = '"$(' * 5000 + "T >: Int" + ')"' * 5000
    assert "T >: Int" in code_of(deep) and '"$' not in code_of(deep)
