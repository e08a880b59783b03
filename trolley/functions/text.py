"""Text functions: item text, tokenizer and stop words, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop-word list of Spark ML's StopWordsRemover
# (StopWordsRemover.loadDefaultStopWords("english")), 181 words, in its own order.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split())

# Fixed value: the whitespace-run pattern of the default regex tokenizer (gaps between tokens).
TOKEN_GAP = r"\s+"


def text_of_item(*cols) -> Column:
    """Null-skipping space join of basket name and item, maker and group names."""
    return F.concat_ws(" ", *cols)


def tokenize(text: Column) -> Column:
    """Lower-case, split on whitespace runs, drop empty tokens (default regex tokenizer)."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP, -1), lambda t: F.length(t) > 0)


def drop_stop_words(tokens: Column, words=ENGLISH_STOP_WORDS) -> Column:
    """Remove stop words, case-insensitively, keeping order and repeats."""
    stop = F.array(*[F.lit(w.lower()) for w in words])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t)))


def sql_tokenize(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: length(t) > 0)"


def sql_stop_words_list() -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
    return f"[{quoted}]"


def sql_drop_stop_words(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({sql_stop_words_list()}, lower(t)))"
