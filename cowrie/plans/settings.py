"""Parameters of the queries: what a deployment would put in its configuration."""

from __future__ import annotations

from cowrie.operators.guard import Rules
from cowrie.operators.segment import Category

KINDS = ("derived", "elicited", "out_of_scope")
TOPICS = ("malaria", "typhoid", "tuberculosis", "hiv", "hypertension", "diabetes", "maternal_health", "child_health", "immunisation", "nutrition", "wash", "mental_health", "covid19")
# Names of the topics for readers.
TOPIC_NAMES = {
    "malaria": "malaria", "typhoid": "typhoid", "tuberculosis": "tuberculosis (TB)", "hiv": "HIV", "hypertension": "high blood pressure", "diabetes": "diabetes", "maternal_health": "maternal health",
    "child_health": "child health", "immunisation": "immunisation", "nutrition": "nutrition", "wash": "water, sanitation, and hygiene", "mental_health": "mental health", "covid19": "COVID-19",
}
DIMENSIONS = ("factual_correctness", "completeness", "linguistic_fluency", "diacritic_accuracy", "cultural_appropriateness")
SPREADING = ("malaria", "typhoid", "tuberculosis (TB)", "HIV", "COVID-19")
# Kinds of claims by words in them, the first that fits, with the question that each answers.
CATEGORIES = [
    Category("symptoms", ("symptom", "sign of", "signs of", "feel like"), "What are the symptoms of {topic}?"),
    Category("causes", ("caused by", "is caused", "cause of", "due to"), "What causes {topic}?"),
    Category("transmission", ("spread", "transmit", "contagious", "infect"), "How does {topic} spread?", only=SPREADING),
    Category("diagnosis", ("detect", "diagnos", "screened", "screening", "confirmation", "measure blood pressure", "blood test", "check-up", "checkup"), "How is {topic} diagnosed?"),
    Category("prevention", ("prevent", "avoid", "protect against", "vaccine", "vaccination"), "How can {topic} be prevented?", never=("immunisation",)),
    Category("treatment", ("treat", "cure", "medicine", "therapy", "manage", "keep appointments", "follow up", "follow-up"), "How is {topic} treated?"),
    Category("complications", ("can affect", "can impair", "can lead to", "complication", "can result in", "quality of life", "can worsen"), "What complications can {topic} cause?"),
    Category("risk", ("risk", "more likely", "higher chance", "vulnerable"), "Who is most at risk from {topic}?"),
    Category("statistics", ("million", "billion", "%", "per 100 000", "per 100000", "estimated at", "reported worldwide", "coverage is estimated", "prevalence"), "How common is {topic} globally?"),
    Category("definition", ("is a form of", "is a type of", "refers to", "is defined as", "also known as", "is known as", "is called", "stands for", "occurs when", "occurs either", "is a chronic", "is a disease that"), "What is {topic}?"),
]
GENERIC = "What should I know about {topic}?"
# Texts that must be answered by a refusal.
UNSAFE = ("dosage", "dose", "mg/kg", "milligram", "how much.*should i take", "prescribe", "prescription", "call an ambulance", "emergency procedure")
UNSAFE_PATTERN = "(?i)" + "|".join(f"(?:{p})" for p in UNSAFE)
REFUSAL = "A ko le dahun ibeere yii. E jowo, e lo ri dokita."
# Words of questions that are in scope, and phrases that ask for a diagnosis, a dosage or a prescription.
SCOPE = (
    "ilera", "arun", "aisan", "oogun", "dokita", "onisegun", "iwosan", "ile-iwosan", "itoju", "ranse", "kokoro", "kokoro arun", "ikolu",
    "iba", "malaria", "typhoid", "taifodu", "tb", "iko", "hiv", "aids", "titeka", "haipatensonu", "titesan", "atosan", "diabetes", "suga",
    "oyun", "aboyun", "ibimo", "omo tuntun", "omo", "ajesara", "abere", "ounje", "ounjeje", "ounje jijẹ", "omi mimu", "imototo", "wash",
    "ilera opolo", "ere okan", "iṣoro ọkan", "covid", "corona", "ara", "iba gbigbona", "eebi", "gbuuru", "orififo", "ikọ", "otutu",
)
BOUNDARY = (
    "iwon oogun", "melo ni mo gbodo mu", "melo ninu oogun", "iwon lati mu", "se mo ni", "se aisan mi ni", "so fun mi arun wo", "yan oogun fun mi",
    "ko oogun fun mi", "fun mi ni oogun", "juwe oogun", "juwe", "dosage", "dose", "mg/kg", "milligram", "prescribe", "prescription",
    "diagnose me", "how much should i take", "what dose",
)
RULES = Rules(
    scope=SCOPE,
    boundary=BOUNDARY,
    out_of_scope_text="A le dahun ibeere nipa ilera nikan.",
    boundary_text="E jowo, e lo ri dokita fun ayewo.",
    disclaimer="Akiyesi: eyi ko ropo imoran dokita.",
)
# The topic of a document by the last part of its address; documents of other addresses have none.
SLUG_TOPICS = {
    "malaria": "malaria", "typhoid": "typhoid", "tuberculosis": "tuberculosis", "hiv-aids": "hiv", "hivaids.html": "hiv", "hypertension": "hypertension",
    "highbloodpressure.html": "hypertension", "diabetes": "diabetes", "diabetes.html": "diabetes", "malnutrition": "nutrition", "malaria.html": "malaria",
    "tuberculosis.html": "tuberculosis", "maternal-mortality": "maternal_health", "children-reducing-mortality": "child_health", "pneumonia": "child_health",
    "diarrhoeal-disease": "child_health", "immunization-coverage": "immunisation", "measles": "immunisation", "obesity-and-overweight": "nutrition",
    "anaemia": "nutrition", "drinking-water": "wash", "sanitation": "wash", "hygiene": "wash", "cholera": "wash", "mental-disorders": "mental_health",
    "depression": "mental_health", "coronavirus-disease-(covid-19)": "covid19", "breastfeeding": "nutrition", "family-planning-contraception": "maternal_health",
    "adolescent-pregnancy": "maternal_health", "food-safety": "nutrition", "physical-activity": "nutrition",
}
SYSTEMS = ("B1", "B2", "B3", "B4", "M")
SEED = 42
