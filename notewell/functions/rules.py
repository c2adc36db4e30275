"""Fixed values of the clinical rules: word lists, patterns and mappings, in the order in which they apply.

The drug vocabulary is a parameter (see ``Vocabulary``); the terms below are only its default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: shorthand before extraction ----
SHORTHAND = [
    (r"\bod\b", "once daily"),
    (r"\bbd\b", "twice daily"),
    (r"\btds\b", "three times daily"),
    (r"\btid\b", "three times daily"),
    (r"\bqid\b", "four times daily"),
    (r"\bqhs\b", "at bedtime"),
    (r"\bhs\b", "at bedtime"),
    (r"\bprn\b", "as needed"),
    (r"\bsos\b", "as needed"),
    (r"\bstat\b", "immediately"),
    (r"\bac\b", "before meals"),
    (r"\bpc\b", "after meals"),
    (r"\bpo\b", "by mouth"),
    (r"\biv\b", "intravenous"),
    (r"\bim\b", "intramuscular"),
    (r"\bsc\b", "subcutaneous"),
    (r"\bsl\b", "sublingual"),
    (r"\bpr\b", "per rectum"),
    (r"\btop\b", "topically"),
    (r"\b1-0-1\b", "twice daily"),
    (r"\b1-1-1\b", "three times daily"),
    (r"\b1-0-0\b", "once daily morning"),
    (r"\b0-0-1\b", "once daily night"),
    (r"\b0-1-0\b", "once daily afternoon"),
    (r"\b1-1-0\b", "twice daily morning and afternoon"),
]

# ---- fixed values: dosage notation to plain English ----
DOSAGE_NOTATION = [
    (r"\b1-0-1\b", "twice daily"),
    (r"\b1-1-1\b", "three times daily"),
    (r"\b1-0-0\b", "once daily in the morning"),
    (r"\b0-0-1\b", "once daily at bedtime"),
    (r"\b0-1-0\b", "once daily in the afternoon"),
    (r"\bx\s*BD\b", "twice daily"),
    (r"\bx\s*OD\b", "once daily"),
    (r"\bx\s*TDS\b", "three times daily"),
    (r"\bx\s*QID\b", "four times daily"),
]

# ---- fixed values: abbreviations of text normalisation ({1} stands for the first group) ----
ABBREVIATIONS = [
    (r"\bmgr\b", "mg"),
    (r"\bmls\b", "mL"),
    (r"\btabs?\b", "tablet"),
    (r"\bcaps?\b", "capsule"),
    (r"\bsusp\b", "suspension"),
    (r"\bsoln\b", "solution"),
    (r"\binj\b", "injection"),
    (r"\bcr\b", "cream"),
    (r"\bont\b", "ointment"),
    (r"\bsupp\b", "suppository"),
    (r"\bod\b", "once daily"),
    (r"\bbd\b", "twice daily"),
    (r"\btds\b", "three times daily"),
    (r"\btid\b", "three times daily"),
    (r"\bqid\b", "four times daily"),
    (r"\bqod\b", "every other day"),
    (r"\bsos\b", "as needed"),
    (r"\bq\.?d\.?\b", "daily"),
    (r"\bb\.?i\.?d\.?\b", "twice daily"),
    (r"\bt\.?i\.?d\.?\b", "three times daily"),
    (r"\bq\.?i\.?d\.?\b", "four times daily"),
    (r"\bq\.?o\.?d\.?\b", "every other day"),
    (r"\bhs\b", "at bedtime"),
    (r"\bq\.?h\.?s\.?\b", "at bedtime"),
    (r"\bac\b", "before meals"),
    (r"\bpc\b", "after meals"),
    (r"\bprn\b", "as needed"),
    (r"\bstat\b", "immediately"),
    (r"\bp\.?o\.?\b", "by mouth"),
    (r"\bi\.?v\.?\b", "intravenous"),
    (r"\bs\.?c\.?\b", "subcutaneous"),
    (r"\bim\b", "intramuscular"),
    (r"\bsl\b", "sublingual"),
    (r"\bpr\b", "per rectum"),
    (r"\btop\b", "topically"),
    (r"\bq([0-9]+)h\b", "every {1} hours"),
]

# ---- fixed values: entity labels that leak into text ----
TEXT_LABELS = [
    "DRUG", "FORM", "STRENGTH", "DOSAGE", "FREQUENCY", "DURATION", "ROUTE", "DISEASE", "SYMPTOM", "ANATOMY", "PROCEDURE", "LAB", "CHEMICAL", "CANCER",
    "Drug", "Form", "Strength", "Dosage", "Frequency", "Duration", "Route", "Disease", "Symptom", "Anatomy", "Dosage Form",
    "Detailed_description", "Sign_symptom", "Disease_disorder", "Biological_structure", "Diagnostic_procedure", "Lab_value", "Severity", "Date", "Occupation",
    "DETAILED_DESCRIPTION", "SIGN_SYMPTOM", "DISEASE_DISORDER", "BIOLOGICAL_STRUCTURE", "DIAGNOSTIC_PROCEDURE", "LAB_VALUE", "SEVERITY", "DATE", "OCCUPATION",
]
OCR_LABELS = "DOSAGE FORM|FORM|STRENGTH|DOSAGE|FREQUENCY|DURATION|ROUTE|DISEASE|SYMPTOM|ANATOMY|PROCEDURE|LAB|CHEMICAL|CANCER|DRUG"

# ---- fixed values: handwriting repairs ----
HANDWRITING = [
    (r"(\d+)\s*ny", "{1}mg"),
    (r"(\d+)\s*uy", "{1}mg"),
    (r"\bT\b", "Tablet"),
    (r"\bBD\b", "twice daily"),
    (r"\bOD\b", "once daily"),
    (r"\bHS\b", "at bedtime"),
    (r"\bSOS\b", "as needed"),
    (r"\b0zin\b", "Ozis"),
    (r"\bStat/808\b", "Stat/SOS"),
]

# ---- fixed values: OCR corrections, applied as substrings in this order ----
OCR_CORRECTIONS = [
    ("zee dol", "zeedol"),
    ("zee odol", "zeedol"),
    ("p hexin", "phexin"),
    ("sto lin", "stolin"),
    ("amphoel", "amphojel"),
    ("belledonna", "belladonna"),
    ("amphojel qs", "amphojel"),
    ("amphojel qs ad", "amphojel"),
    ("amphoel qs", "amphojel"),
    ("amphoel qs ad", "amphojel"),
    (" me", " mg"),
    ("me ", "mg "),
    (" me ", " mg "),
    ("mgdical", "medical"),
    ("mgllitus", "mellitus"),
    ("mgt", "mg"),
    ("dmg", "mg"),
    ("dyspwalking", "dyspnea walking"),
    ("dyspneaed", "dyspnea"),
    ("hemoptysismoptysis", "hemoptysis"),
    ("orthopneanea", "orthopnea"),
]
#: The unit corrections among them, which strict mode applies after a digit only.
OCR_UNIT_CORRECTIONS = {" me", "me ", " me ", "mgt", "dmg"}
OCR_PATTERNS = [
    (r"zee\s*dol", "zeedol"),
    (r"p\s*hexin", "phexin"),
    (r"sto\s*lin", "stolin"),
    (r"(\d+)(freq)", "{1} {2}"),
    (r"(\d+)(days?|weeks?|months?)", "{1} {2}"),
    (r"(\d-\d)(days?|weeks?|months?)", "{1} {2}"),
]
OCR_PHRASES = ["gum paint", "electric brush", "tooth brush", "col gate", "oral b"]
BROKEN_WORDS = [
    (r"##", ""),
    (r"(?i)\b(zee)\s*(dol)\b", "zeedol"),
    (r"(?i)\b(sto)\s*(lin)\b", "stolin"),
    (r"(?i)\b(p)\s*(hexin)\b", "phexin"),
    (r"(?i)\b(amp)\s*(ho)\s*(jel)\b", "amphojel"),
    (r"(?i)\b(belle)\s*(donna)\b", "belledonna"),
    (r"(?i)(days|weeks|months)\s*(days|weeks|months)", "{1}"),
]
OCR_NORMALISE = [
    (r"([a-z])([A-Z])", "{1} {2}"),
    (r"##+", ""),
    (r"(\d+)\s*(mg|ml|g|mcg|tabs|caps)", "{1} {2}"),
    (r"(\d+\s*mg)\s*(\d-\d-\d)", "{1} |FREQ| {2}"),
    (r"(\d)\s*-\s*(\d)\s*-\s*(\d)", "{1}-{2}-{3}"),
    (r"x\s*(\d+)\s*(days?|weeks?|months?)", "{1} {2}"),
    (r"[^a-zA-Z0-9\-\s]", " "),
    (r"\b[a-zA-Z]{1,2}\b", " "),
]

# ---- fixed values: extraction patterns over lower-cased text ----
DOSAGE = r"\b\d+\s?(mg|ml|g|mcg|unit|units|tab|tabs|cap|caps)\b"
FREQUENCY = r"(once daily|twice daily|thrice daily|every \d+ hours|od|bd|tds|qid|qhs|prn|daily|nightly|weekly|monthly)"
DISEASES = [
    "chronic obstructive pulmonary disease|copd|chronic bronchitis|emphysema|asthma",
    "bronchitis|pneumonia|pneumonitis|pleuritis|pleural effusion",
    "tuberculosis|tb|pulmonary fibrosis|interstitial lung disease|ild",
    "pulmonary embolism|pe|acute respiratory distress syndrome|ards",
    "sleep apnea|obstructive sleep apnea|osa|hypoxemia|hypercapnia",
    "hypertension|htn|high blood pressure|hypotension|low blood pressure",
    "heart failure|hf|congestive heart failure|chf|cardiomyopathy",
    "coronary artery disease|cad|ischemic heart disease|ihd|angina|myocardial infarction|mi",
    "atrial fibrillation|af|afib|ventricular tachycardia|vt|bradycardia",
    "peripheral artery disease|pad|aortic aneurysm|aortic stenosis|mitral regurgitation",
    "deep vein thrombosis|dvt|pulmonary embolism|pe|varicose veins",
    "diabetes mellitus|type 1 diabetes|type 2 diabetes|t1dm|t2dm|dm",
    "diabetic ketoacidosis|dka|hyperosmolar hyperglycemic state|hhs",
    "diabetic nephropathy|diabetic retinopathy|diabetic neuropathy",
    "gastroesophageal reflux disease|gerd|acid reflux|peptic ulcer disease|pud",
    "irritable bowel syndrome|ibs|inflammatory bowel disease|ibd|crohn's disease|ulcerative colitis",
    "appendicitis|diverticulitis|diverticulosis|pancreatitis|cholecystitis|hepatitis|cirrhosis",
    "migraine|headache|tension headache|cluster headache",
    "stroke|cerebrovascular accident|cva|transient ischemic attack|tia|seizure|epilepsy",
    "parkinson's disease|alzheimer's disease|dementia|multiple sclerosis|ms",
    "neuropathy|peripheral neuropathy|gbs|guillain-barre syndrome",
    "depression|major depressive disorder|mdd|dysthymia|bipolar disorder|mania",
    "anxiety disorder|generalized anxiety disorder|gad|panic disorder|ptsd|ocd",
    "schizophrenia|psychosis|delirium|dementia",
    "cancer|carcinoma|tumor|neoplasm|malignancy|metastasis",
    "breast cancer|lung cancer|prostate cancer|colorectal cancer|ovarian cancer",
    "leukemia|lymphoma|melanoma|sarcoma",
    "urinary tract infection|uti|sepsis|septicemia|bacteremia|cellulitis|abscess",
    "meningitis|encephalitis|endocarditis|osteomyelitis|sinusitis|pharyngitis|tonsillitis",
    "arthritis|osteoarthritis|rheumatoid arthritis|ra|gout|osteoporosis",
    "fracture|sprain|strain|tendinitis|bursitis|carpal tunnel syndrome",
    "scoliosis|kyphosis|herniated disc|slipped disc|sciatica|low back pain|lbp",
    "eczema|dermatitis|psoriasis|acne|urticaria|hives|contact dermatitis|atopic dermatitis",
    "herpes|shingles|varicella|impetigo|cellulitis|fungal infection|tinea",
    "anemia|iron deficiency anemia|ida|thalassemia|sickle cell disease",
    "thyroid disease|hypothyroidism|hyperthyroidism|goiter|hashimoto's thyroiditis|graves' disease",
    "chronic kidney disease|ckd|acute kidney injury|aki|nephrotic syndrome|nephritis",
    "hyperlipidemia|dyslipidemia|high cholesterol|obesity|overweight|malnutrition",
    "hypokalemia|hyperkalemia|hyponatremia|hypernatremia|metabolic acidosis|metabolic alkalosis",
    "allergy|allergic rhinitis|hay fever|food allergy|drug allergy|latex allergy",
    "hiv|aids|hepatitis b|hepatitis c|std|sti|sexually transmitted infection",
]
SYMPTOMS = [
    "chest pain|angina|chest discomfort|substernal pain|retrosternal pain",
    "abdominal pain|stomach pain|belly pain|gastric pain|epigastric pain",
    "back pain|low back pain|lumbar pain|sciatica|radicular pain",
    "joint pain|arthralgia|bone pain|muscle pain|myalgia",
    "headache|migraine|throbbing pain|sharp pain|dull pain|aching",
    "shortness of breath|dyspnea|dyspnoea|sob|breathlessness|difficulty breathing",
    "cough|dry cough|productive cough|wet cough|chronic cough|whooping cough",
    "wheezing|wheeze|stridor|tachypnea|rapid breathing|hyperventilation",
    "hemoptysis|coughing blood|blood in sputum|bloody sputum",
    "nasal congestion|runny nose|rhinorrhea|sneezing|postnasal drip",
    "nausea|vomiting|emesis|retching|dry heaves",
    "diarrhea|constipation|loose stools|watery stools|bloody diarrhea",
    "heartburn|indigestion|dyspepsia|bloating|abdominal distension|flatulence",
    "loss of appetite|anorexia|weight loss|unintentional weight loss|weight gain",
    "difficulty swallowing|dysphagia|odynophagia|painful swallowing",
    "palpitations|racing heart|irregular heartbeat|skipped beats|fluttering",
    "chest tightness|chest pressure|chest heaviness|squeezing chest",
    "syncope|fainting|presyncope|near fainting|lightheadedness|dizziness|vertigo",
    "edema|swelling|peripheral edema|ankle swelling|leg swelling|pitting edema",
    "claudication|intermittent claudication|leg pain on walking",
    "weakness|muscle weakness|fatigue|tiredness|lethargy|malaise|exhaustion",
    "numbness|tingling|paresthesia|pins and needles|burning sensation",
    "tremor|shaking|rigidity|bradykinesia|slowness of movement",
    "confusion|disorientation|memory loss|forgetfulness|cognitive impairment",
    "difficulty speaking|dysarthria|aphasia|slurred speech",
    "vision changes|blurred vision|double vision|diplopia|vision loss|blindness",
    "seizure|convulsion|fit|aura|loss of consciousness|loc",
    "fever|high temperature|pyrexia|hyperthermia|chills|rigor|rigors",
    "night sweats|diaphoresis|excessive sweating|hyperhidrosis",
    "rash|skin rash|erythema|pruritus|itching|urticaria|hives",
    "bruising|ecchymosis|petechiae|purpura|bleeding|hemorrhage",
    "insomnia|difficulty sleeping|sleep disturbance|restless sleep|hypersomnia",
    "anxiety|nervousness|worry|panic|fear|restlessness|agitation",
    "depressed mood|sadness|hopelessness|worthlessness|guilt|suicidal ideation",
    "constitutional symptoms|b symptoms|fever night sweats weight loss",
]
DURATIONS = [
    r"\b(for\s+\d+\s+(day|days|week|weeks|month|months|year|years))\b",
    r"\b(\d+\s+(day|days|week|weeks|month|months|year|years)\s+ago)\b",
    r"\b(since\s+\w+\s+ago)\b",
    r"\b(over\s+the\s+last\s+\d+\s+(day|days|week|weeks|month|months))\b",
]

# ---- fixed values: labels, colours, categories ----
LABEL_MAP = {
    "DRUG": "DRUG", "DOSAGE": "DOSAGE", "DURATION": "DURATION", "FORM": "FORM", "FREQUENCY": "FREQUENCY", "ROUTE": "ROUTE", "STRENGTH": "STRENGTH",
    "CHEMICAL": "DRUG", "ANATOMY": "ANATOMY", "DISEASE": "DISEASE", "CANCER": "CANCER", "ORGANISM": "ORGANISM", "Chemical": "DRUG", "Disease": "DISEASE",
    "Medication": "DRUG", "Dose": "DOSAGE", "Frequency": "FREQUENCY", "Route": "ROUTE", "Duration": "DURATION", "Condition": "DISEASE", "Symptom": "SYMPTOM",
    "Detailed_description": "Detailed_description", "Sign_symptom": "SYMPTOM", "Disease_disorder": "DISEASE", "Biological_structure": "ANATOMY",
    "Diagnostic_procedure": "PROCEDURE", "Lab_value": "LAB", "Dosage Form": "FORM", "Severity": "SEVERITY", "Date": "DATE", "Occupation": "OCCUPATION",
}
COLOURS = {
    "DRUG": "#ffcfcc", "DOSAGE": "#d3f9d8", "STRENGTH": "#b2f2bb", "DURATION": "#fff3bf", "FORM": "#eebefa", "FREQUENCY": "#d0ebff", "ROUTE": "#fff4e6",
    "DISEASE": "#ffc9c9", "SYMPTOM": "#ffa8a8", "ANATOMY": "#c5f6fa", "PROCEDURE": "#ffe8cc", "LAB": "#e3fafc", "CHEMICAL": "#ffec99", "CANCER": "#ff6b6b",
}
OTHER_COLOUR = "#f0f0f0"
CATEGORIES = {
    "DRUG": "drug", "DISEASE": "disease", "SYMPTOM": "symptom", "ANATOMY": "anatomy", "DOSAGE": "dosage", "STRENGTH": "dosage", "FREQUENCY": "frequency",
    "DURATION": "duration", "ROUTE": "route", "FORM": "form", "PROCEDURE": "procedure", "LAB": "lab", "CHEMICAL": "drug", "CANCER": "disease",
}

# ---- fixed values: entity clean-up ----
KEEP_SHORT = ["bd", "od", "tds", "qid", "prn", "sos", "sr", "er", "xl", "xr"]
NON_MEDICAL = ["gum", "paint", "brush", "electric brush", "wash", "electric", "pt", "col", "gate", "b pro", "m ft", "ft", "qs", "qsad", "toothbrush", "colgate", "oralb", "dental"]
NON_CLINICAL = ["brush", "electric", "toothbrush", "oral b", "colgate", "pro 2", "2000n", "tooth", "dental"]
NOISE_FRAGMENTS = ["qsad", "ft", "m ft", "qs", "ad"]
FREQ_WORDS = ["daily", "twice", "once", "thrice", "nightly", "weekly", "monthly", "hourly"]
DOSE_FORMS = ["tablet", "tab", "capsule", "cap", "sachet", "puff", "drop", "suppository", "patch", "syrup", "suspension"]
ROUTE_WORDS = ["oral", "iv", "topical", "mouth", "eye", "ear"]
FORM_WORDS = ["tablet", "tab", "capsule", "cap", "syrup", "syr", "injection", "inj", "ointment", "cream", "amp", "ampoule", "sol", "solution"]
LEADING_FORMS = ["solution", "tablet", "tab", "capsule", "cap", "syrup", "injection", "inj", "ointment", "cream", "amp", "ampoule"]
NAME_PREFIXES = ["tn", "rx", "tab", "tablet", "cap", "capsule", "inj", "injection", "syrup", "syr", "sol", "solution", "pt", "sr", "xr"]
NAME_SUFFIXES = ["er", "sr", "xl", "xr"]
DRUG_NOISE = ["brush", "electric", "paint", "wash", "gate", "pro", "oralb", "oral b", "electricbrush", "dental", "toothbrush", "colgate", "plax", "mouthwash", "col", "hexin", "lin"]
DRUG_BANNED = ["colgate", "plax", "colgate plax", "mouthwash", "oral b", "oralb", "electric brush", "electricbrush", "toothbrush"]
ROUTE_DESCRIPTORS = ["inhaled", "oral", "topical", "intravenous", "intramuscular", "subcutaneous", "sublingual", "rectal", "vaginal", "ophthalmic", "otic", "nasal", "buccal", "transdermal", "enteral", "parenteral"]
GENERIC_CLASSES = [
    "corticosteroid", "steroid", "antibiotic", "antibacterial", "antiviral", "antifungal", "bronchodilator", "antihistamine", "analgesic", "antipyretic",
    "antiinflammatory", "vasodilator", "diuretic", "antihypertensive", "hypoglycemic", "anticoagulant", "beta-blocker", "betablocker", "ace inhibitor",
    "statin", "antidepressant", "antipsychotic", "anxiolytic", "sedative", "laxative", "antacid", "antiemetic",
]
NON_MEDICAL_CONTEXT = ["brush", "paint", "tooth", "dental", "electric", "gum", "wash", "gate", "col", "oral", "colgate"]

# ---- fixed values: medication lines ----
LINE_STRENGTH = r"\b(\d+)\s*(mg|ml|g|mcg|fre|q|units?|tab|cap)\b"
LINE_STRENGTH_WORD = r"\b(\d+)\s+([a-z]+)\b"
LINE_STRENGTH_UNITS = ["solution", "sol", "ml", "mg", "g", "mcg"]
LINE_FREQUENCIES = [
    r"\b\d-\d-\d\b",
    r"\b(three|two|one)\s+times?\s+(daily|day)\b",
    r"\b(thrice|twice|once)\s+daily\b",
    r"\b(three|two|one)\s+times?\s+a\s+day\b",
    r"\b(three|two|one)\s+times?\b",
    r"\bdaily\b",
    r"\bnightly\b",
    r"\bweekly\b",
    r"\bmonthly\b",
]
LINE_DURATION = r"(\d+)\s*(days?|weeks?|months?|seg)\b"
LINE_DURATION_UNIT = r"\b(days?|weeks?|months?)\b"
LINE_ROUTE = r"\b(oral|iv|topical|eye|ear|mouth)\b"
MIXED_FREQUENCY = r"(three|two|one)\s+times?|thrice|twice|once|daily"

# ---- fixed values: protected health information ----
PHI_SERVICE = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b",
    "PHONE": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "DATE": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    "MRN": r"\b(MRN|Medical Record #|MR#)\s*:?\s*\d+\b",
    "DOB": r"\b(DOB|Date of Birth|Birth Date)\s*:?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "ADDRESS": r"\b\d+\s+[A-Za-z]+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b",
    "ZIP": r"\b\d{5}(-\d{4})?\b",
    "NAME": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    "MEDICAL_ID": r"\b(ID|Patient ID|Account #)\s*:?\s*\d+\b",
}
NOT_NAMES = ["heart attack", "blood pressure", "chest pain", "high blood"]
PHI_DETECTOR = [
    ("SSN", r"(?i)\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", 0.95),
    ("PHONE", r"(?i)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.90),
    ("EMAIL", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.98),
    ("MRN", r"(?i)\b(?:MRN|Medical Record Number|Patient ID|ID Number)[\s:#]*(\d{3,10})\b", 0.85),
    ("DATE_OF_BIRTH", r"(?i)\b(?:DOB|Date of Birth|Birth Date)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", 0.80),
    ("ADDRESS", r"(?i)\b\d+\s+[A-Za-z0-9\s,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way)\b", 0.75),
    ("FULL_NAME", r"(?i)\b(?:Dr|Mr|Mrs|Ms|Miss)?\s*[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+(?:Jr|Sr|MD|PhD))?\b", 0.70),
]

# ---- fixed values: prescription details ----
RX_ABBREVIATIONS = {
    "od": "Once Daily", "bd": "Twice Daily", "tid": "Three Times Daily", "qid": "Four Times Daily", "sos": "If Needed", "prn": "As Needed", "stat": "Immediately", "hs": "At Bedtime",
    "ac": "Before Meals", "pc": "After Meals", "tab": "Tablet", "cap": "Capsule", "syr": "Syrup", "inj": "Injection", "mg": "Milligram", "ml": "Milliliter",
}
RX_DOSAGES = r"(\d+(?:\.\d+)?\s*(?:mg|gm|ml|mcg|iu))"
RX_FREQUENCIES = r"\b(od|bd|tid|qid|sos|prn|stat|hs|ac|pc)\b"
RX_DURATIONS = r"(\d+\s*(?:day|days|week|weeks|month|months))"

# ---- fixed values: document classes, FHIR codes, text quality ----
DOCUMENT_CLASSES = [
    ("prescription", ["rx", "tab", "cap", "mg", "dose", "take", "sig", "dispense", "refill"]),
    ("clinical_note", ["chief complaint", "history of present illness", "review of systems", "physical exam", "assessment", "plan"]),
    ("report", ["medical report", "laboratory report", "radiology report", "pathology report", "diagnosis"]),
]
FREQUENCY_CODES = [("daily", "BID"), ("twice daily", "BID"), ("three times daily", "TID"), ("four times daily", "QID"), ("as needed", "PRN"), ("once daily", "QD")]
ROUTE_CODES = [("oral", "26643006"), ("intravenous", "47625008"), ("topical", "421526004"), ("subcutaneous", "34206005"), ("inhaled", "410942007")]
QUALITY_WORDS = ["mg", "tab", "cap", "dose", "take", "days", "week", "rx", "prescription"]

# ---- fixed values: default vocabulary and brands ----
COMMON_DRUGS = [
    "Sitagliptin", "Metformin", "Losartan", "Atorvastatin", "Amlodipine", "Naproxen", "Ibuprofen", "Paracetamol", "Amoxicillin", "Azithromycin", "Ciprofloxacin",
    "Doxycycline", "Omeprazole", "Pantoprazole", "Ranitidine", "Cetirizine", "Loratadine", "Montelukast", "Salbutamol", "Formoterol", "Metoprolol",
    "Hydrochlorothiazide", "Furosemide", "Spironolactone", "Aspirin", "Clopidogrel", "Warfarin", "Insulin", "Glimepiride", "Gabapentin", "Pregabalin",
    "Duloxetine", "Sertraline", "Escitalopram",
]
BRANDS = {
    "phexin": "cephalexin", "zeedol": "aceclofenac", "zerodol": "aceclofenac", "stolin": "stolin", "belledonna": "belladonna", "amphojel": "amphojel",
    "disprin": "aspirin", "crocin": "paracetamol", "dolo": "paracetamol", "tylenol": "paracetamol", "advil": "ibuprofen", "motrin": "ibuprofen",
    "brufen": "ibuprofen", "glucophage": "metformin", "glycomet": "metformin", "prilosec": "omeprazole", "lipitor": "atorvastatin", "atorva": "atorvastatin",
    "zestril": "lisinopril", "prinivil": "lisinopril", "lopressor": "metoprolol", "toprol": "metoprolol", "norvasc": "amlodipine", "stamlo": "amlodipine",
    "amlip": "amlodipine", "lasix": "furosemide", "rosuvas": "rosuvastatin", "crestor": "rosuvastatin", "zithromax": "azithromycin", "ciplox": "ciprofloxacin",
    "cifran": "ciprofloxacin", "flagyl": "metronidazole", "metrogyl": "metronidazole", "augmentin": "amoxicillin-clavulanate", "asthalin": "salbutamol",
    "montek": "montelukast", "thyronorm": "levothyroxine", "eltroxin": "levothyroxine", "wysolone": "prednisolone", "medrol": "methylprednisolone",
    "lyrica": "pregabalin", "pregeb": "pregabalin", "januvia": "sitagliptin", "amaryl": "glimepiride",
}


def _default_terms() -> list[str]:
    return sorted({d.lower() for d in COMMON_DRUGS} | set(BRANDS.values()) | {"belladonna", "amphojel", "stolin", "insulin glargine"})


@dataclass(frozen=True)
class Vocabulary:
    """Known drug terms (lower case) and brands; both are parameters. ``sources.read_terms`` loads terms of any number from a table."""

    drugs: list[str] = field(default_factory=_default_terms)
    brands: dict[str, str] = field(default_factory=lambda: dict(BRANDS))

#: Fixed values: (system, code, display) of a FHIR Condition's clinical and verification status.
CONDITION_ACTIVE = ("http://terminology.hl7.org/CodeSystem/condition-clinical", "active", "Active")
CONDITION_CONFIRMED = ("http://terminology.hl7.org/CodeSystem/condition-ver-status", "confirmed", "Confirmed")

#: Labels that the anatomy and chemistry model may give, and the names under which labels are shown.
BIO_MODEL_LABELS = ["ANATOMY", "CHEMICAL", "ORGANISM"]
DISPLAY_LABELS = {
    "FREQUENCY_LATIN": "Frequency",
    "FORM": "Dosage Form",
    "STRENGTH": "Strength",
    "DURATION": "Duration",
    "ROUTE": "Route",
    "DRUG": "Drug",
    "DOSAGE": "Dosage",
    "DISEASE": "Disease",
    "SYMPTOM": "Symptom",
    "ANATOMY": "Anatomy",
    "PROCEDURE": "Procedure",
    "LAB": "Lab",
    "LATIN_INSTRUCTION": "Instruction",
    "UNCERTAIN": "Uncertain",
}
