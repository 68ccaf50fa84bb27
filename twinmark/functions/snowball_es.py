"""Spanish Snowball stemmer, written from the published Snowball algorithm description.

A per-word helper: the stemming job applies it once per distinct word (see
``operators.udf_jobs.stem_job``), never per token occurrence.
"""

from __future__ import annotations

# ---- fixed values of the published Spanish Snowball algorithm ----------------------------------
VOWELS = "aeiouáéíóúü"
STEP0_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
STEP0_AFTER_ACCENTED = ("iéndo", "ándo", "ár", "ér", "ír")
STEP0_AFTER_PLAIN = ("ando", "iendo", "ar", "er", "ir")
STEP1_DELETE_R2 = ("amientos", "imientos", "amiento", "imiento", "anzas", "ismos", "ables", "ibles", "istas",
                   "anza", "icos", "icas", "ismo", "able", "ible", "ista", "osos", "osas", "ico", "ica", "oso", "osa")
STEP1_ADOR = ("aciones", "adoras", "adores", "ancias", "adora", "ación", "antes", "ancia", "ador", "ante")
STEP1_LOGIA = ("logías", "logía")
STEP1_UCION = ("uciones", "ución")
STEP1_ENCIA = ("encias", "encia")
STEP1_IDAD = ("idades", "idad")
STEP1_IVA = ("ivas", "ivos", "iva", "ivo")
STEP2A = ("yeron", "yendo", "yamos", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó")
STEP2B_GU = ("emos", "éis", "en", "es")
STEP2B_DELETE = (
    "aríamos", "eríamos", "iríamos", "iéramos", "iésemos", "aríais", "aremos", "eríais", "eremos", "iríais",
    "iremos", "ierais", "ieseis", "asteis", "isteis", "ábamos", "áramos", "ásemos", "arían", "arías", "aréis",
    "erían", "erías", "eréis", "irían", "irías", "iréis", "ieran", "iesen", "ieron", "iendo", "ieras", "ieses",
    "abais", "arais", "aseis", "íamos", "arán", "arás", "aría", "erán", "erás", "ería", "irán", "irás", "iría",
    "iera", "iese", "aste", "iste", "aban", "aran", "asen", "aron", "ando", "abas", "adas", "idas", "aras",
    "ases", "íais", "ados", "idos", "amos", "imos", "ará", "aré", "erá", "eré", "irá", "iré", "aba", "ada",
    "ida", "ara", "ase", "ían", "ado", "ido", "ías", "áis", "ía", "ad", "ed", "id", "an", "ió", "ar", "er",
    "ir", "as", "ís")
STEP3_RV = ("os", "a", "o", "á", "í", "ó")
STEP3_E = ("e", "é")
ACCENTS = str.maketrans("áéíóú", "aeiou")
# -------------------------------------------------------------------------------------------------


def _is_vowel(c: str) -> bool:
    return c in VOWELS


def _r1(w: str) -> int:
    for i in range(1, len(w)):
        if not _is_vowel(w[i]) and _is_vowel(w[i - 1]):
            return i + 1
    return len(w)


def _regions(w: str) -> tuple[int, int, int]:
    r1 = _r1(w)
    r2 = r1 + _r1(w[r1:]) if r1 < len(w) else len(w)
    rv = len(w)
    if len(w) >= 2:
        if not _is_vowel(w[1]):
            for i in range(2, len(w)):
                if _is_vowel(w[i]):
                    rv = i + 1
                    break
        elif _is_vowel(w[0]) and _is_vowel(w[1]):
            for i in range(2, len(w)):
                if not _is_vowel(w[i]):
                    rv = i + 1
                    break
        else:
            rv = 3 if len(w) >= 3 else len(w)
    return r1, min(r2, len(w)), rv


def _longest(w: str, suffixes) -> str | None:
    best = None
    for s in suffixes:
        if w.endswith(s) and (best is None or len(s) > len(best)):
            best = s
    return best


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 2:
        return w
    r1, r2, rv = _regions(w)

    # step 0: attached pronoun
    suf = _longest(w, STEP0_PRONOUNS)
    if suf and len(w) - len(suf) >= rv:
        base = w[: -len(suf)]
        pre = _longest(base, STEP0_AFTER_ACCENTED)
        if pre and len(base) - len(pre) >= rv:
            w = base[: -len(pre)] + pre.translate(ACCENTS)
        else:
            pre = _longest(base, STEP0_AFTER_PLAIN)
            if pre and len(base) - len(pre) >= rv:
                w = base
            elif base.endswith("yendo") and len(base) - 5 >= rv and base[:-5].endswith("u"):
                w = base
    r1, r2, rv = min(r1, len(w)), min(r2, len(w)), min(rv, len(w))

    # step 1: standard suffixes
    before = w
    groups = [STEP1_DELETE_R2, STEP1_ADOR, STEP1_LOGIA, STEP1_UCION, STEP1_ENCIA, ("amente",), ("mente",),
              STEP1_IDAD, STEP1_IVA]
    suf = _longest(w, [s for g in groups for s in g])
    if suf:
        start = len(w) - len(suf)
        if suf in STEP1_DELETE_R2 and start >= r2:
            w = w[:start]
        elif suf in STEP1_ADOR and start >= r2:
            w = w[:start]
            if w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
        elif suf in STEP1_LOGIA and start >= r2:
            w = w[:start] + "log"
        elif suf in STEP1_UCION and start >= r2:
            w = w[:start] + "u"
        elif suf in STEP1_ENCIA and start >= r2:
            w = w[:start] + "ente"
        elif suf == "amente" and start >= r1:
            w = w[:start]
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            else:
                for p in ("os", "ic", "ad"):
                    if w.endswith(p) and len(w) - 2 >= r2:
                        w = w[:-2]
                        break
        elif suf == "mente" and start >= r2:
            w = w[:start]
            for p in ("ante", "able", "ible"):
                if w.endswith(p) and len(w) - len(p) >= r2:
                    w = w[: -len(p)]
                    break
        elif suf in STEP1_IDAD and start >= r2:
            w = w[:start]
            for p in ("abil", "ic", "iv"):
                if w.endswith(p) and len(w) - len(p) >= r2:
                    w = w[: -len(p)]
                    break
        elif suf in STEP1_IVA and start >= r2:
            w = w[:start]
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    rv = min(rv, len(w))

    if w == before:
        # step 2a: verb suffixes beginning with y, after u
        suf = _longest(w, STEP2A)
        done = False
        if suf and len(w) - len(suf) >= rv and w[: -len(suf)].endswith("u"):
            w = w[: -len(suf)]
            done = True
        if not done:
            # step 2b: other verb suffixes
            suf = _longest(w, STEP2B_GU + STEP2B_DELETE)
            if suf and len(w) - len(suf) >= rv:
                w = w[: -len(suf)]
                if suf in STEP2B_GU and w.endswith("gu"):
                    w = w[:-1]
    rv = min(rv, len(w))

    # step 3: residual suffix
    suf = _longest(w, STEP3_RV + STEP3_E)
    if suf and len(w) - len(suf) >= rv:
        w = w[: -len(suf)]
        if suf in STEP3_E and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACCENTS)
