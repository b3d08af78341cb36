"""Fixed values about the four languages of the corpus."""

from __future__ import annotations

import unicodedata

# Frequent function words of each language, most frequent first.
FUNCTION_WORDS = {
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas foi ao das à seu sua ou ser quando muito há nos já está também só pelo pela até isso ela entre era depois sem mesmo aos quem nas me esse eles essa num nem suas meu às minha pelos elas seja qual este esta cada nosso nossa porque embora apesar disso segundo assim talvez",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up what its about than into them can only other some could then my do also may our each another because although after despite between neither nor",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra ese eso mí antes algunos qué unos yo otro otras ha según cada después hacer aunque",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont cette avec aux son mais ou comme on sa ses été ces leur tout deux si nous même aussi sans peut très entre après lorsque chaque selon puis ni cela notre ainsi afin malgré",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def fold(word: str) -> str:
    """The word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
