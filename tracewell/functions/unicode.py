"""Unicode form C. Spark has no function for it, so texts that may need it, and only these, go to Python in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with their accents on them, and all before them, stay as they are: one cheap look settles most texts.
BEYOND_LATIN = r"[^\x00-\x{02FF}]"
#: What form C can change: marks that join a letter before them, vowels and finals of Hangul, and characters that stand for others.
MAY_CHANGE = r"[\p{M}\x{1161}-\x{11FF}\x{0374}\x{037E}\x{0387}\x{0958}-\x{095F}\x{09DC}-\x{09DF}\x{0A33}\x{0A36}\x{0A59}-\x{0A5E}\x{0B5C}\x{0B5D}\x{0F43}-\x{0F69}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{110BA}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"


@F.pandas_udf(StringType())
def _form_c(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def form_c(text: Column) -> Column:
    """The text in form C; one that can't change isn't sent anywhere."""
    some = F.when(text.rlike(BEYOND_LATIN) & text.rlike(MAY_CHANGE), text)
    return F.coalesce(_form_c(some), text)
