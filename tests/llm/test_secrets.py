"""Literals that the lexer has to reach, and text that it has to leave alone."""

import time

import pytest

from storystream.llm.secrets import literal_spans

SECRET = "x9Kq2Lm8Zt4Wv7Rb"


def found(text):
    return {text[start:end] for start, end, _ in literal_spans(text)}


@pytest.mark.parametrize(
    "text",
    [
        'password = "{}"',
        'password: str = "{}"',
        "password: Optional[str] = '{}'",
        'cfg["password"] = "{}"',
        "os.environ['API_TOKEN'] = '{}'",
        'SECRET_KEY = """{}"""',
        "SECRET_KEY = '''{}'''",
        'DEFAULT = "{}"\nclient(password=DEFAULT)',
        'client(password=DEFAULT)\nDEFAULT = "{}"',
        'password = FIRST\nFIRST = SECOND\nSECOND = "{}"',
        '{{"db": {{"password": "{}"}}}}',
    ],
)
def test_literals_of_sensitive_names(text):
    assert found(text.format(SECRET)) == {SECRET}


def test_escaped_quotes_stay_inside():
    assert found(r'password = "x9Kq2\"Lm8Zt4Wv7Rb"') == {r"x9Kq2\"Lm8Zt4Wv7Rb"}


def test_only_passphrases_are_made_of_words():
    words = "correct horse battery staple"
    assert found(f'passphrase = "{words}"') == found(f'pass_phrase: str = "{words}"') == {words}
    assert found(f'password = "{words}"') == found(f'title = "{words}"') == set()


@pytest.mark.parametrize("text", ["", "=", ":", "]=", '"]=', 'a = "', "a = '''", "x: y = ", "a = a", "a = b\nb = a"])
def test_broken_syntax_has_no_secrets(text):
    assert found(text) == set()


def test_names_that_are_not_sensitive():
    assert found(f'colour: str = "{SECRET}"\ncfg["colour"] = "{SECRET}"') == set()


@pytest.mark.parametrize(
    "text",
    [
        "\n".join(f"a{i} = a{i + 1}" for i in range(20_000)),
        "token: " * 40_000,
        "token = x" * 40_000,
        'a = "' + "\\" * 200_000,
        "a=[" * 60_000,
    ],
)
def test_long_texts_take_time_in_proportion(text):
    start = time.perf_counter()
    literal_spans(text)
    assert time.perf_counter() - start < 10
