"""Ordered rule tables for titles, employment types and shifts: the first rule that matches decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import bound
from .text import normalize_title

# Words that name a leading or a clerical post, and the rules in their order. A rule is a category,
# its words, and whether it holds only for titles without a leading or clerical word.
LEADING = "manager|director|chief|supervisor|vice president|gestionnaire|chef de service|chef d equipe|chef de secteur|cheffe de service|cheffe d equipe|cheffe de secteur|directeur|directrice"
CLERICAL = "clerk|secretary|administrative|receptionist|scheduler|registration|clerical|office assistant|agent administratif|agente administrative|secretaire medicale|commis|procedes administratifs|office admin|office administration|transcription|transcriptionist|concierge|payroll"
TITLE_RULES = (
    ("nursing", "registered nurse|practical nurse|nurse practitioner|nursing|nurse|infirmier|infirmiere|infirmiers|infirmieres|soins infirmiers", False),
    ("allied_health", "physician assistant", False),
    ("physicians", r"physician(?!\s+(assistant|recruitment|liaison|services|relations|advisor))|surgeon|anesthesiologist|anaesthesiologist|anaesthetist|hospitalist|psychiatrist|cardiologist|oncologist|radiologist|gastroenterologist|otolaryngologist|physiatrist|obstetrician|gynecologist|gynaecologist|neurologist|nephrologist|dermatologist|urologist|internist|intensivist|pediatrician|paediatrician|geriatrician|endocrinologist|rheumatologist|hematologist|haematologist|respirologist|pulmonologist|ophthalmologist|medecin|medecins", False),
    ("mental_health", "psychologists?|psychologue|crisis intervention|crisis worker|crisis counsellor|crisis counselor|clinical counsellor|clinical counselor|addictions? counsellor|addictions? counselor", False),
    ("mental_health", "mental health|psychiatric|addictions?|substance use|withdrawal management|mhsu|mh su|sante mentale|psychiatrie|toxicomanie|dependances", True),
    ("support_care", "personal support worker|health care aide|care aide|continuing care assistant|resident assistant|resident attendant|home care attendant|community care assistant|home support worker|patient support assistant|patient attendant|porter|orderly|guest attendant|care support assistant|unregulated care provider|medication care partner|prepose aux beneficiaires|preposee aux beneficiaires|auxiliaire aux services de sante|auxiliaires aux services de sante|aide soignant|aide soignante", False),
    ("paramedics", "paramedics?|emergency medical responder|emergency med responder|emergency medical technician", False),
    ("diagnostics_lab", "laboratory technologist|laboratory assistant|laboratory technician|lab technician|radiation technologist|radiological technologist|radiology technologist|m r t|mri technologist|mri specialty technologist|ct technologist|ultrasound technologist|cardiology technologist|cardiovascular technologist|pacemaker technologist|echocardiographer|sonographer|ultrasonographer|phlebotomist|cytotechnologist|imaging technologist|nuclear medicine technologist|polysomnographic technologist|polysomnography|x ray technologist|technologiste medical|technologiste medicale|technologue en radiologie|technologue en imagerie|technologue en electrophysiologie|cytotechnologiste", False),
    ("pharmacy", "pharmacist|pharmacy technician|pharmacy assistant|pharmacy specialist|pharmacy practice assistant|pharmacy student|pharm d|pharmd|pharmacien|pharmacienne", False),
    ("allied_health", "occupational therapist|physiotherapist|respiratory therapist|speech language pathologist|speech pathologist|dietitian|audiologist|social worker|therapist|therapy assistant|rehabilitation assistant|physiotherapy assistant|occupational therapy assistant|communicative disorders assistant|genetic counsellor|genetic counselor|kinesiologist|dietetic technician|orthopaedic technician|orthopedic technician|recreation assistant|recreation worker|recreation aide|recreation coordinator|recreation therapy worker|activity worker|activity aide|activity assistant|activation aide|leisure service aide|resident engagement assistant|perfusionist|anesthesia assistant|anaesthesia assistant|ergotherapeute|physiotherapeute|inhalotherapeute|orthophoniste|(?<!aide )dietetiste|(?<!aide )nutritionniste|travailleur social|travailleuse sociale|audiologiste|kinesiologue|hygieniste dentaire|recreologue|en dietetique", False),
    ("research", "research associate|research assistant|research coordinator|research scientist|clinical scientist|postdoctoral|clinical trial", False),
    ("food_services", "cook|cooks|cuisinier|cuisiniere|chef cuisinier|chef|aide dietetiste|aide nutritionniste|food services|food service|service alimentaire|services alimentaires|aide alimentaire|dietary aide|diet aide|dietary worker|dishwasher|kitchen helper|kitchen aide|kitchen assistant|hospitality service associate|hospitality services associate|hospitality aide|server|nutrition services worker", True),
    ("environmental_services", "environmental services|environmental service|environmental attendant|environmental aide|housekeeping|housekeeper|cleaner|custodian|custodial|laundry|linen|entretien menager|hygiene et salubrite|salubrite|buanderie", True),
    ("facilities_trades", "maintenance|power engineer|stationary engineer|engineer (1st|2nd|3rd|4th|5th) class|building operator|electrician|plumber|pipefitter|carpenter|millwright|refrigeration mechanic|hvac|painter|groundskeeper|grounds keeper|handyman|tradesperson|menuisier|menuisiere|mecanicien de machines fixes|machines fixes|biomedical engineering technologist|biomedical engineering technician|biomedical technologist|instrumentation", True),
    ("security", "(?<!(information|cyber|data|it) )(security officer|security guard|security coordinator|relational security)|patrol officer|protection services officer|protection officer|institutional safety officer", True),
    ("management", LEADING, False),
    ("admin_clerical", CLERICAL, False),
)
# Roles in their order, with category and words; no words means the whole category.
NO_ROLE = "manager|director|chief|vice president|gestionnaire|directeur|directrice"
ROLES = (
    ("nurse-practitioner", "nursing", "nurse practitioner|infirmiere praticienne|infirmier praticien"),
    ("registered-psychiatric-nurse", "nursing", "registered psychiatric nurse|registered psych nurse|psychiatric nurse"),
    ("practical-nurse", "nursing", "practical nurse|infirmiere auxiliaire|infirmier auxiliaire"),
    ("registered-nurse", "nursing", "registered nurse|nurse [ab]|general duty nurse|staff nurse|clinical nurse|nurse clinician|nurse educator|infirmiere clinicienne|infirmier clinicien|infirmiere|infirmier"),
    ("personal-support-worker", "support_care", "personal support worker|health care aide|care aide|continuing care assistant|resident assistant|resident attendant|home support worker|home care attendant|community care assistant|prepose aux beneficiaires|preposee aux beneficiaires|auxiliaire aux services de sante"),
    ("pharmacy-technician", "pharmacy", "pharmacy technician|technicien en pharmacie|technicienne en pharmacie"),
    ("pharmacist", "pharmacy", "pharmacist|pharm d|pharmd|pharmacien|pharmacienne"),
    ("physiotherapist", "allied_health", "physiotherapist|physical therapist|physiotherapeute"),
    ("occupational-therapist", "allied_health", "occupational therapist|ergotherapeute"),
    ("respiratory-therapist", "allied_health", "respiratory therapist|inhalotherapeute"),
    ("speech-language-pathologist", "allied_health", "speech language pathologist|speech pathologist|orthophoniste"),
    ("therapy-assistant", "allied_health", "rehabilitation assistant|therapy assistant|physiotherapy assistant|occupational therapy assistant"),
    ("dietitian", "allied_health", "dietitian|(?<!aide )dietetiste|(?<!aide )nutritionniste"),
    ("social-worker", "allied_health", "social worker|travailleur social|travailleuse sociale"),
    ("psychologist", "mental_health", "psychologists?|psychologue"),
    ("medical-laboratory-technologist", "diagnostics_lab", "medical laboratory technologist|laboratory technologist|combined laboratory|technologiste medical|technologiste medicale"),
    ("laboratory-assistant", "diagnostics_lab", "laboratory assistant|lab assistant|laboratory technician|lab technician|phlebotomist"),
    ("sonographer", "diagnostics_lab", "sonographer|ultrasonographer|ultrasound technologist|echocardiographer"),
    ("medical-radiation-technologist", "diagnostics_lab", "medical radiation technologist|radiation technologist|radiological technologist|radiology technologist|x ray technologist|mri technologist|ct technologist|nuclear medicine technologist|technologue en radiologie|technologue en imagerie"),
    ("paramedic", "paramedics", "paramedics?|emergency medical responder|emergency medical technician"),
    ("physician", "physicians", None),
    ("unit-clerk", "admin_clerical", "unit clerk|ward clerk|unit secretary|health unit coordinator"),
    ("medical-office-assistant", "admin_clerical", "medical office assistant|medical secretary|medical receptionist|secretaire medicale"),
    ("cook", "food_services", "cook|cooks|cuisinier|cuisiniere"),
    ("dietary-aide", "food_services", "dietary aide|diet aide|dietary worker|food service worker|food services worker|aide alimentaire"),
    ("housekeeping-aide", "environmental_services", "housekeeping aide|housekeeper|housekeeping attendant|environmental services aide|environmental services worker|environmental attendant|environmental aide|cleaner|custodian"),
)
# Words for employment types in order of precedence, and for shifts in a posting's header.
EMPLOYMENT_RULES = (
    ("casual", r"\b(casual|per[ _-]?diem|on[ -]?call|relief|occasional)\b"),
    ("temporary", r"\b(temporary|temp|term|intern|seasonal|summer)\b"),
    ("contract", r"\b(contract|contractor)\b"),
    ("full_time", r"\b(full[ _-]?time|regular full)\b"),
    ("part_time", r"\b(part[ _-]?time|regular part)\b"),
)
SHIFT_RULES = (("rotating", "rotat|various"), ("day", r"\bdays?\b"), ("evening", r"\bevenings?\b"), ("night", r"\bnights?\b"), ("weekend", r"\bweekends?\b"))


def first_match(cases: list[tuple[Column, str]]) -> Column:
    """The value of the first true case, else null, as one chain that stays in generated code."""
    start = F.when(cases[0][0], F.lit(cases[0][1]))
    return reduce(lambda chain, case: chain.when(case[0], F.lit(case[1])), cases[1:], start)


def _word(words: str) -> str:
    return rf"\b({words})\b"


def classify_normal(normal: Column) -> Column:
    busy = normal.rlike(_word(f"{LEADING}|{CLERICAL}"))
    return first_match([(normal.rlike(_word(words)) & ~busy if guarded else normal.rlike(_word(words)), name) for name, words, guarded in TITLE_RULES])


def classify(title: Column) -> Column:
    """Category of a title by the first rule, null where none matches."""
    return bound(normalize_title(title), classify_normal)


def role_of(title: Column) -> Column:
    """Slug of a title's role, null for leading posts and where no role matches."""

    def role(normal: Column) -> Column:
        cases = [(normal.rlike(_word(words)) if words else F.coalesce(classify_normal(normal) == category, F.lit(False)), slug) for slug, category, words in ROLES]
        return F.when(~normal.rlike(_word(NO_ROLE)), first_match(cases))

    return bound(normalize_title(title), role)


def employment_type(*fields: Column, fte: Column | None = None) -> Column:
    """Type named by the first field that names one; a full-time equivalent of 1 or more is full time."""
    one = lambda c: bound(F.lower(c), lambda low: first_match([(low.rlike(words), name) for name, words in EMPLOYMENT_RULES]))
    found = F.coalesce(*[one(c) for c in fields])
    if fte is None:
        return found
    share = F.try_to_number(F.regexp_extract(fte, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("999.99")).cast("double")
    return F.coalesce(found, F.when(share >= 1, "full_time").when(share > 0, "part_time"))


def shift_pattern(c: Column) -> Column:
    """Shift of a list of shifts: more than one of day, evening and night rotates; weekend counts only alone."""

    def shift(parts: Column) -> Column:
        starts = lambda word: F.exists(parts, lambda p: p.startswith(word))
        has = {word: starts(word) for word in ("day", "evening", "night", "weekend")}
        core = sum((has[w].cast("int") for w in ("day", "evening", "night")), F.lit(0))
        return F.when(core > 1, "rotating").when(has["day"], "day").when(has["evening"], "evening").when(has["night"], "night").when(has["weekend"], "weekend")

    return bound(F.transform(F.split(F.lower(c), "[,;]"), lambda p: F.trim(p)), shift)


def shift_keyword(c: Column) -> Column:
    """Shift named in a posting's header."""
    return first_match([(F.lower(c).rlike(words), name) for name, words in SHIFT_RULES])
