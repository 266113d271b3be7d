"""Stopword lists, always passed as an argument and never held as shared state."""

from __future__ import annotations

# The French stopword list of the Snowball project, as Apache Spark's
# StopWordsRemover ships it under the name "french".
FRENCH_WORDS = tuple(
    """
    au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même
    mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes
    toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante
    étants étantes suis es est sommes êtes sont serai seras sera serons serez seront serais
    serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent
    sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante
    ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront
    aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes
    eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent
    """.split()
)
# Agency abbreviations that are dropped besides the French list.
AGENCY_WORDS = ("dime", "dim", "du", "dt", "ds", "dip", "df", "dcti", "dse", "dspe")


def stopwords(custom=AGENCY_WORDS) -> list[str]:
    """French list joined with ``custom``, sorted and free of repeats."""
    return sorted({*FRENCH_WORDS, *custom})
