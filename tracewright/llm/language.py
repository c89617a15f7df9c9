"""Language of a text with code in it, from scripts and function words."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more two like him see than been now its who did made may only over such after because before while until since says both once should could must does do very just where why my you he her our us any no nor own same too most again further between under above below against during through".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder aber vor zur bis mehr durch man dann soll schon wenn danach immer wir ohne ich würde zuerst dieser diese kein keine wurde waren sein seine ihre ihr uns kann können muss damit weil ob dabei jetzt hier unter zwischen gegen während wieder also sowie bereits jede jeder beim vom ins".split(),
    "fr": "l d n qu j c s le la les de des du et un une est en que qui dans pour sur au aux avec par pas ne il elle nous vous ils ce cette ces son sa ses mais ou où donc plus sont être avons été dès après avant même si depuis quand je tu on leur leurs notre votre nos vos comme sans sous entre aussi ainsi alors encore très bien peut doit fait faire tout tous toute chaque lors car déjà ici cela".split(),
    "es": "el la los las de del y un una es en que se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde desde todo nos durante antes después está son no ha han fue ser si estos estas ese esa eso cada así aún solo además mientras tiene puede debe hace cual quien todos otra otro nuestro ahora aquí".split(),
    "it": "l il lo la i gli le il del dello della dei delle degli e un uno una è in che si per con non da al alla sono come più ma anche dopo prima nel nella questo questa quando senza ha hanno era essere se ogni così ancora solo mentre può deve fa tutto tutti altri altra nostro ora qui dove perché".split(),
    "pt": "o a os as de do da dos das e um uma é em que se por com para não na no nas nos ao aos como mais mas também depois antes este esta isso quando sem foi são pelo pela ter tem ser está estão cada assim ainda só enquanto pode deve faz tudo todos outra outro nosso agora aqui onde porque já até".split(),
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij nog door wordt naar dan deze dit wanneer zonder worden werd was waren heeft hebben kan moet zo elke alleen terwijl nu hier waar omdat over uit tot onder tussen tegen tijdens weer dus al geen mijn ons onze".split(),
}
_LANGS = {w: [k for k, v in FUNCTION_WORDS.items() if w in v] for v in FUNCTION_WORDS.values() for w in v}
_FENCED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.DOTALL)
_NO_PROSE = re.compile(r"[/\\_\d]|\(\)|[a-z][A-Z]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Code point ranges of scripts that tell the language.
_SCRIPTS = (("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("zh", 0x3400, 0x4DBF), ("ko", 0xAC00, 0xD7AF), ("ru", 0x0400, 0x04FF), ("ar", 0x0600, 0x06FF), ("he", 0x0590, 0x05FF), ("el", 0x0370, 0x03FF), ("th", 0x0E00, 0x0E7F), ("hi", 0x0900, 0x097F))


def language(text: str) -> str | None:
    """Language code, or None if the text gives no clear sign. Code, paths and identifiers don't count."""
    plain = " ".join([w for w in _FENCED.sub(" ", text).split() if not _NO_PROSE.search(w)])
    if not plain.isascii():
        scripts: Counter[str] = Counter()
        for ch in plain:
            c = ord(ch)
            if c > 0x36F:
                for name, low, high in _SCRIPTS:
                    if low <= c <= high:
                        scripts[name] += 1
                        break
        letters = sum(map(str.isalpha, plain))
        if scripts and sum(scripts.values()) >= 0.2 * letters:
            return "ja" if scripts["ja"] >= 0.05 * sum(scripts.values()) else scripts.most_common(1)[0][0]
    votes: Counter[str] = Counter()
    for word in _WORD.findall(plain.lower().replace("’", "'")):
        elided = word.partition("'") if "'" in word else (word, "", "")
        for part in (elided[0], elided[2]):
            # A letter alone is an article only where it is elided.
            if len(part) > 1 or elided[1] or part in "aeoy":
                for name in _LANGS.get(part, ()):
                    votes[name] += 1
    ranked = votes.most_common(2)
    if not ranked or ranked[0][1] < 2:
        return None
    if len(ranked) == 2 and ranked[0][1] < 1.3 * ranked[1][1]:
        return None
    return ranked[0][0]
