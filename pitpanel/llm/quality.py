"""Quality rules on whole texts, line by line first, with built-in functions only.

Each line with a word is held against rules of punctuation, navigation and boilerplate. Failing lines are removed, and a
text that loses too much of itself that way is rejected. Base measures of the whole text are counted beside it.

Intermediate arrays are bound once with one-element ``transform`` calls, so no array is computed again for each element.
Nothing is exploded or shuffled: a row's result depends on that row alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that separate words, and characters that count as symbols.
SEPARATORS = " \\t\\n\\u000B\\u000C\\r"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that is looked for twice in a text.
WINDOW = 5

#: A text fails the base rules below so many words, or above so many hundredths of repeated words.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A line fails above so many symbols in a hundred characters, or with so many menu bars.
MOST_SYMBOLS, MENU_BARS = 10, 3
#: A line of so many words must end a sentence (a longer one is prose even if cut off); one of at least so many must not be all capitals.
FRAGMENT_WORDS, SHOUTED_WORDS = (3, 20), 4
#: The least share of a text's line characters that must stay, in hundredths.
LEAST_LEFT = 50
# Ends of sentences, and phrases of page furniture.
SENTENCE_END = "[.!?…。！？:;][\"”’»)\\\\]]*[ \\\\t\\\\r]*$"
BOILERPLATE = ["cookie", "javascript", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum",
               "sign up", "log in", "subscribe", "click here", "read more", "share this"]


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated_words() -> str:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more, from the array ``w``."""
    hashes = f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64(slice(w, i + 1, {WINDOW})))"
    found = f"""filter(transform(sequence(0, size(s) - 1), k -> if(
        coalesce(s[k].x = get(s, k - 1).x, false) or coalesce(s[k].x = get(s, k + 1).x, false), s[k].i, -1)), i -> i >= 0)"""
    covered = f"""aggregate(sort_array(p), named_struct('n', 0L, 'last', -{WINDOW}),
        (a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)"""
    by_hash = "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))"
    some = _let("s", by_hash, _let("p", found, covered))
    return f"if(size(w) < {WINDOW}, 0L, {_let('h', hashes, f'if(size(array_distinct(h)) = size(h), 0L, {some})')})"


def _line_fails() -> str:
    """Why the line ``l`` fails: punctuation, navigation or boilerplate; NULL if it doesn't."""
    bars = "length(l) - length(replace(l, '|', ''))"
    symbols = f"100 * regexp_count(l, '{SYMBOLS}') > {MOST_SYMBOLS} * length(l)"
    spaces = "regexp_count(trim(l), '[ \\\\t]+')"
    phrases = "|".join(BOILERPLATE)
    return f"""(case when {bars} >= {MENU_BARS} then 'navigation'
        when {symbols} then 'punctuation'
        when not (l rlike '{SENTENCE_END}') and {spaces} between {FRAGMENT_WORDS[0] - 1} and {FRAGMENT_WORDS[1] - 1} then 'punctuation'
        when l rlike '\\\\p{{Lu}}' and not (l rlike '\\\\p{{Ll}}') and {spaces} >= {SHOUTED_WORDS - 1} then 'boilerplate'
        when lower(l) rlike '{phrases}' then 'boilerplate' end)"""


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Base measures and the verdict of line-first cleaning for every row.

    The key columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
    left_percent, ``cleaned`` (the lines that stay, one line feed between) and kept. A NULL text counts as empty: no words, so it fails.
    Rows that repeat are judged each; other columns are not looked at.
    """
    slim = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text_"))
    words = f"split(trim(BOTH '{SEPARATORS}' FROM _text_), '[ \\\\t-\\\\r]+')"
    by_words = f"""if(trim(BOTH '{SEPARATORS}' FROM _text_) = '', named_struct('n_words', 0L, 'word_chars', 0L, 'n_repeat_words', 0L),
        {_let('w', words, f'''named_struct('n_words', cast(size(w) as long), 'word_chars', cast(length(array_join(w, '')) as long),
              'n_repeat_words', {_repeated_words()})''')})"""
    lines = "filter(split(_text_, '\\n'), l -> l rlike '[^ \\\\t-\\\\r]')"
    good = f"filter(ls, l -> {_line_fails()} is null)"
    by_lines = _let("ls", lines, _let("g", good, """named_struct(
        'n_lines', cast(size(ls) as long), 'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as long),
        'n_lines_removed', cast(size(ls) - size(g) as long), 'chars', cast(length(array_join(ls, '')) as long),
        'cleaned', array_join(g, '\\n'), 'left', cast(length(array_join(g, '')) as long))"""))
    both = slim.select(*keys, F.expr(f"cast(regexp_count(_text_, '{SYMBOLS}') as long)").alias("n_symbols"),
                       F.expr(by_words).alias("_w_"), F.expr(by_lines).alias("_l_"))
    failed = (F.col("_w_.n_words") < LEAST_WORDS) | (100 * F.col("_w_.n_repeat_words") > MOST_REPEATED * F.col("_w_.n_words"))
    left = F.when(F.col("_l_.chars") > 0, 100.0 * F.col("_l_.left") / F.col("_l_.chars")).otherwise(0.0)
    return both.select(*keys, "_w_.n_words", "_w_.word_chars", "n_symbols", "_l_.n_dup_lines", "_w_.n_repeat_words", failed.alias("base_failed"),
                       (~failed & (left >= LEAST_LEFT)).alias("kept"), "_l_.n_lines", "_l_.n_lines_removed", left.alias("left_percent"), "_l_.cleaned")
