"""Tables, limits and texts that results depend on."""

VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
CONSONANTS = ("B", "CH", "D", "DH", "F", "G", "HH", "JH", "K", "L", "M", "N", "NG", "P", "R", "S", "SH", "T", "TH", "V", "W", "Y", "Z", "ZH")
#: Consonants of one group stand in for each other; any vowel stands in for any vowel.
CONSONANT_GROUPS = (
    ("TH", "T", "D", "S", "Z", "F"), ("DH", "D", "Z"), ("T", "D"), ("P", "B"), ("K", "G"), ("S", "Z", "SH"), ("CH", "SH", "JH"), ("N", "NG", "M"), ("V", "W"), ("L", "R"),
)
#: Sounds that the acoustic model never gives.
UNSCORABLE = ("ZH", "OY")
UNSCORABLE_TIP = "The model cannot judge this sound yet, so it is not counted."

TIPS = {
    "AA": "Open your mouth wide, like saying 'ah' at the doctor.",
    "AE": "Open your mouth and spread your lips slightly, like 'cat'.",
    "AH": "Relax your mouth - a short, neutral 'uh' sound.",
    "AO": "Round your lips slightly and say 'aw' as in 'thought'.",
    "AW": "Start with 'ah' and glide to 'oo', like 'cow'.",
    "AY": "Start with 'ah' and glide to 'ee', like 'my'.",
    "B": "Press your lips together, then release with a burst of air.",
    "CH": "Touch the tip of your tongue to the roof of your mouth, then release - 'ch' as in 'cheese'.",
    "D": "Touch your tongue to the ridge behind your top teeth, then release.",
    "DH": "Put your tongue between your teeth and vibrate - 'th' as in 'the'.",
    "EH": "Open your mouth slightly and say 'eh' as in 'bed'.",
    "ER": "Curl your tongue slightly back - 'er' as in 'bird'.",
    "EY": "Start with 'eh' and glide to 'ee' - 'ay' as in 'say'.",
    "F": "Lightly bite your lower lip and push air through.",
    "G": "Touch the back of your tongue to the soft palate, then release.",
    "HH": "Simply breathe out through your open mouth.",
    "IH": "Relax your tongue slightly - 'ih' as in 'sit'.",
    "IY": "Spread your lips and raise the front of your tongue - 'ee' as in 'see'.",
    "JH": "Touch your tongue to the roof of your mouth and release - 'j' as in 'judge'.",
    "K": "Touch the back of your tongue to the soft palate, then release with a puff.",
    "L": "Touch the tip of your tongue to the ridge behind your top teeth.",
    "M": "Press your lips together and hum.",
    "N": "Touch your tongue to the ridge behind your top teeth and hum.",
    "NG": "Touch the back of your tongue to the soft palate and hum - 'ng' as in 'sing'.",
    "OW": "Round your lips and glide from 'oh' to 'oo' - 'oh' as in 'go'.",
    "OY": "Round your lips for 'aw' then glide to 'ee' - 'oy' as in 'boy'.",
    "P": "Press your lips together, then release with a puff of air.",
    "R": "Curl your tongue slightly back without touching the roof.",
    "S": "Place your tongue close to the ridge behind your top teeth and push air through.",
    "SH": "Round your lips slightly and push air through - 'sh' as in 'she'.",
    "T": "Touch your tongue to the ridge behind your top teeth, then release sharply.",
    "TH": "Put your tongue between your teeth and push air - 'th' as in 'think'.",
    "UH": "Round your lips slightly - 'uh' as in 'book'.",
    "UW": "Round your lips tightly - 'oo' as in 'food'.",
    "V": "Lightly bite your lower lip and vibrate.",
    "W": "Round your lips tightly and then open - 'w' as in 'we'.",
    "Y": "Raise the front of your tongue toward the roof - 'y' as in 'yes'.",
    "Z": "Like 'S', but add vibration from your vocal cords.",
    "ZH": "Round your lips and push air with vibration - 'zh' as in 'measure'.",
}
DEFAULT_TIP = ("Focus on clearly articulating '", "'.")
CLARITY = {
    "R": "Make the American R tighter and more centered. Avoid a tapped or rolled sound.",
    "ER": "Hold the vowel-r color together as one smooth sound instead of splitting it apart.",
    "IH": "Keep /IH/ short and relaxed, not stretched toward /IY/.",
    "IY": "Keep /IY/ high and tense, like a clear 'ee' sound.",
    "AE": "Open the jaw more for /AE/ and keep it bright, not flat.",
    "AH": "Use a short, central /AH/ instead of a broad open vowel.",
    "AA": "Keep /AA/ open and steady without drifting toward /AH/ or /AO/.",
    "AO": "Round /AO/ slightly so it does not flatten out.",
    "UH": "Keep /UH/ short and rounded, not tense like /UW/.",
    "UW": "Push the lips forward more for /UW/ and keep it tense.",
    "TH": "Keep the tongue lightly between the teeth for /TH/, not behind them.",
    "DH": "For /DH/, keep the tongue between the teeth and add voicing.",
    "V": "Let the lower lip touch the upper teeth and keep the sound voiced.",
    "W": "Round the lips strongly for /W/ and release quickly.",
    "T": "Make /T/ clean and crisp without adding an extra vowel after it.",
    "D": "Keep /D/ short and voiced without turning it into a flap or extra syllable.",
}
DEFAULT_CLARITY = "Slow the word down and keep each sound clean without adding extra vowel sounds."
FEEDBACK = {
    "great": "Great! The phoneme match is strong.",
    "clear": "Every sound was there. Say it a little more clearly for a top score.",
    "focus": "Focus on the highlighted sounds.",
    "empty": "I didn't hear anything clearly. Try again?",
    "close": ("Close. I heard '", "', but the pronunciation is not clear enough yet for a top score."),
}

#: Broad regions that a contributor may name, by country.
REGIONS = {
    "US": ("NE", "S", "MW", "W"), "GB": ("ENG_S", "ENG_N", "SCT", "WLS", "NIR"), "AU": ("E", "SA", "W"), "CA": ("ATL", "QC", "ON", "W"), "IE": ("E", "S", "W"), "IN": ("N", "S", "E", "W"),
}
HOME_ACCENT = {"US": "ga", "GB": "rp", "AU": "au"}
ACCENTS = ("ga", "rp", "au")
EXPORT_KIND, EXPORT_VERSION = "contributions", 2
MAX_TAKES_PER_CONTRIBUTOR = 40
MAX_STORED = 60
MAX_ABS_FEATURE = 60.0
FEATURES = 256
MIN_CONTRIBUTORS, MIN_TAKES = 8, 200

EXTRA_SOUNDS = "extra sounds, likely background noise"
TOO_FEW_SOUNDS = "too few sounds heard"
VIABILITY = {
    "speech_seconds": 0.25, "snr_db": 20.0, "clipped": 0.005, "confidence": 0.5, "matched": 30.0, "shortest": 0.5, "longest_practice": 1.5, "longest_voice": 2.0,
}

IPA_VOWELS = {
    "ə": ("AH",), "ɐ": ("AH",), "ɪ": ("IH",), "ɛ": ("EH",), "æ": ("AE",), "ɒ": ("AA",), "ʊ": ("UH",), "i": ("IY",), "iː": ("IY",), "uː": ("UW",), "ɔː": ("AO",), "ɑː": ("AA",),
    "ɜː": ("ER",), "eɪ": ("EY",), "aɪ": ("AY",), "əʊ": ("OW",), "aʊ": ("AW",), "ɔɪ": ("OY",), "ɪə": ("IH", "AH"), "ɛə": ("EH", "AH"), "ʊə": ("UH", "AH"),
}
IPA_CONSONANTS = {
    "p": "P", "b": "B", "t": "T", "d": "D", "k": "K", "g": "G", "f": "F", "v": "V", "s": "S", "z": "Z", "h": "HH", "m": "M", "n": "N", "l": "L", "w": "W", "ɹ": "R", "j": "Y",
    "ŋ": "NG", "ʃ": "SH", "ʒ": "ZH", "θ": "TH", "ð": "DH", "tʃ": "CH", "dʒ": "JH",
}
KEEP_SHORT_I_BEFORE = ("K", "G", "NG", "SH", "CH", "JH", "ZH")
AUSTRALIAN_LONG_A = ("can't", "aunt", "aunts", "shan't")

IPA = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɝ", "EY": "eɪ", "IH": "ɪ", "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u",
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ",
    "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
IPA_REDUCED = {"AH": "ə", "ER": "ɚ"}
IPA_BRITISH = {"AA": "ɑː", "AO": "ɔː", "ER": "ɜː", "OW": "əʊ", "UW": "uː", "EH": "e", "R": "r", "IY": "iː"}
IPA_BRITISH_REDUCED = {"AH": "ə", "ER": "ɚ", "IY": "i"}
ONSETS = (
    "P L", "P R", "B L", "B R", "T R", "D R", "K L", "K R", "K W", "G L", "G R", "F L", "F R", "TH R", "SH R", "S P", "S T", "S K", "S M", "S N", "S L", "S W", "T W", "D W", "K Y",
    "M Y", "B Y", "P Y", "F Y", "HH Y", "V Y", "S P R", "S P L", "S T R", "S K R", "S K W", "S K Y",
)
ACCENT_NAMES = {"ga": "American", "rp": "British", "au": "Australian"}
NON_RHOTIC = ("rp", "au")
