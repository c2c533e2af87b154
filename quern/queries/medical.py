"""Patients, their symptoms and diagnoses: label filters, tri-state flags and unions of modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.models.base import ExpressionModel, ModelSpec
from quern.operators import semantic as sem
from quern.plans.plan import in_all, union_of
from quern.queries.registry import Book
from quern.tables import table

query = Book()

ALLERGY = "The symptoms point to an allergy: {symptoms}"
ACNE = "The symptoms point to acne: {symptoms}"
LUNGS_HEALTHY = "The lungs sound healthy"
LUNGS_SICK = "The lungs sound sick"
XRAY_SICK = "The x-ray shows a disease"
MALIGNANT = "The skin picture shows a malignant growth"
DISEASE = "Which disease do the symptoms point to: {symptoms}"
SKIN_AND_XRAY = "Both the skin picture and the x-ray show a disease"

_sick = lambda c, *healthy: ~F.col(c).isin("none", *healthy)
GOLD = ExpressionModel(
    {
        ALLERGY: lambda *_: F.col("text_diagnosis") == "allergy",
        ACNE: lambda *_: F.col("text_diagnosis") == "acne",
        LUNGS_HEALTHY: lambda *_: F.col("audio_diagnosis") == "normal",
        LUNGS_SICK: lambda *_: _sick("audio_diagnosis", "normal"),
        XRAY_SICK: lambda *_: _sick("x_ray_diagnosis", "00_normal"),
        MALIGNANT: lambda *_: F.col("skin_cancer_diagnosis") == "malignant",
        DISEASE: lambda *_: F.lower("text_diagnosis"),
        SKIN_AND_XRAY: lambda *_: (F.col("skin_cancer_diagnosis") == "malignant") & _sick("x_ray_diagnosis", "00_normal"),
    },
    ModelSpec("gold"),
)
COLUMNS = ["age", "gender", "smoking_history", "did_family_have_cancer", "patient_id"]


def _patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patients")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symptoms_texts").join(_patients(spark, d), "patient_id")


@query("""SELECT DISTINCT p.age, p.gender, p.smoking_history, p.did_family_have_cancer, p.patient_id FROM patients p
    JOIN symptoms_texts s ON p.patient_id = s.patient_id WHERE p.text_diagnosis = 'allergy'""")
def patients_with_allergy(spark: SparkSession, d: str) -> DataFrame:
    """Patients whose symptoms point to an allergy."""
    return sem.sem_filter(_reports(spark, d), ALLERGY, GOLD).select(COLUMNS).distinct()


@query("SELECT age, gender, smoking_history, did_family_have_cancer, patient_id FROM patients WHERE smoking_history <> 'Current' AND audio_diagnosis = 'normal'")
def patients_healthy_lungs(spark: SparkSession, d: str) -> DataFrame:
    """Patients who don't smoke now and whose lungs sound healthy."""
    return sem.sem_filter(_patients(spark, d).filter("smoking_history <> 'Current'"), LUNGS_HEALTHY, GOLD).select(COLUMNS)


@query("""SELECT patient_id FROM patients WHERE did_family_have_cancer = 1 AND x_ray_diagnosis NOT IN ('00_normal', 'none') ORDER BY patient_id LIMIT 5""")
def patients_cancer_family(spark: SparkSession, d: str) -> DataFrame:
    """Five patients with cancer in the family and a sick x-ray."""
    family = _patients(spark, d).filter("did_family_have_cancer = 1")
    return sem.sem_filter(family, XRAY_SICK, GOLD).select("patient_id").orderBy("patient_id").limit(5)


@query("SELECT round(avg(p.age), 6) AS average_acne_age FROM patients p JOIN symptoms_texts s ON p.patient_id = s.patient_id WHERE p.text_diagnosis = 'acne'")
def patients_acne_age(spark: SparkSession, d: str) -> DataFrame:
    """Mean age over the reports of acne."""
    return sem.sem_filter(_reports(spark, d), ACNE, GOLD).agg(F.round(F.avg("age"), 6).alias("average_acne_age"))


@query("""SELECT smoking_history, count(*) AS "count" FROM patients WHERE smoking_history = 'Current' AND audio_diagnosis NOT IN ('none', 'normal')
    AND x_ray_diagnosis NOT IN ('none', '00_normal') GROUP BY smoking_history""")
def patients_sick_smokers(spark: SparkSession, d: str) -> DataFrame:
    """Smokers sick by both sound and x-ray."""
    smokers = sem.sem_filter(_patients(spark, d).filter("smoking_history = 'Current'"), LUNGS_SICK, GOLD)
    return sem.sem_filter(smokers, XRAY_SICK, GOLD).groupBy("smoking_history").agg(F.count(F.lit(1)).alias("count"))


_F = "CASE WHEN {0} IS NULL OR {0} = 'none' THEN NULL WHEN {0} IN ('normal', '00_normal') THEN 0 ELSE 1 END"


@query(f"""WITH f AS (SELECT patient_id, {_F.format('text_diagnosis')} AS by_text, {_F.format('audio_diagnosis')} AS by_sound, {_F.format('x_ray_diagnosis')} AS by_xray FROM patients)
    SELECT * FROM f WHERE (by_text = 1 OR by_sound = 1 OR by_xray = 1) AND (by_text = 0 OR by_sound = 0 OR by_xray = 0)""")
def patients_contradictory(spark: SparkSession, d: str) -> DataFrame:
    """Patients sick by one modality and healthy by another."""
    flag = lambda c: F.when(F.col(c).isNull() | (F.col(c) == "none"), None).when(F.col(c).isin("normal", "00_normal"), 0).otherwise(1)
    f = _patients(spark, d).select("patient_id", flag("text_diagnosis").alias("by_text"), flag("audio_diagnosis").alias("by_sound"), flag("x_ray_diagnosis").alias("by_xray"))
    return f.filter("(by_text = 1 OR by_sound = 1 OR by_xray = 1) AND (by_text = 0 OR by_sound = 0 OR by_xray = 0)")


@query("""SELECT patient_id FROM patients WHERE text_diagnosis = 'allergy' UNION SELECT patient_id FROM patients WHERE audio_diagnosis NOT IN ('none', 'normal')
    UNION SELECT patient_id FROM patients WHERE x_ray_diagnosis NOT IN ('none', '00_normal') UNION SELECT patient_id FROM patients WHERE skin_cancer_diagnosis = 'malignant'""")
def patients_sick_anyhow(spark: SparkSession, d: str) -> DataFrame:
    """Patients sick by any of four modalities."""
    p = _patients(spark, d)
    return union_of("patient_id", *[sem.sem_filter(p.withColumn("symptoms", F.lit("")), x, GOLD) for x in (ALLERGY, LUNGS_SICK, XRAY_SICK, MALIGNANT)])


@query("SELECT patient_id FROM patients WHERE did_family_have_cancer = 1 AND skin_cancer_diagnosis = 'malignant' ORDER BY patient_id LIMIT 100")
def patients_malignant_family(spark: SparkSession, d: str) -> DataFrame:
    """A hundred patients with cancer in the family and a malignant growth."""
    return sem.sem_filter(_patients(spark, d).filter("did_family_have_cancer = 1"), MALIGNANT, GOLD).select("patient_id").orderBy("patient_id").limit(100)


@query("SELECT patient_id FROM patients WHERE skin_cancer_diagnosis = 'malignant' AND x_ray_diagnosis NOT IN ('none', '00_normal')")
def patients_skin_and_xray(spark: SparkSession, d: str) -> DataFrame:
    """One prompt over two pictures."""
    return sem.sem_filter(_patients(spark, d), SKIN_AND_XRAY, GOLD).select("patient_id")


@query("""SELECT lower(p.text_diagnosis) AS disease, count(*) AS n FROM patients p JOIN symptoms_texts s ON p.patient_id = s.patient_id GROUP BY 1""")
def sem_map(spark: SparkSession, d: str) -> DataFrame:
    """Reports by the disease that the model names."""
    named = sem.sem_map(_reports(spark, d), DISEASE, GOLD, "disease")
    return named.groupBy("disease").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT gender FROM patients WHERE text_diagnosis = 'allergy' AND gender IS NOT NULL INTERSECT SELECT gender FROM patients WHERE skin_cancer_diagnosis = 'malignant'""")
def sem_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Genders with both an allergy and a malignant growth."""
    p = _patients(spark, d).withColumn("symptoms", F.lit(""))
    return in_all("gender", sem.sem_filter(p, ALLERGY, GOLD), sem.sem_filter(p, MALIGNANT, GOLD))


@query("""SELECT patient_id, max(CASE WHEN place = 'chest' THEN 1 END) AS chest, max(CASE WHEN place = 'throat' THEN 1 END) AS throat FROM
    (SELECT patient_id, unnest(regexp_extract_all(lower(symptoms), 'chest|throat')) AS place FROM symptoms_texts WHERE patient_id IS NOT NULL) GROUP BY patient_id""")
def pivot_max_if(spark: SparkSession, d: str) -> DataFrame:
    """Per patient a flag for each place that the reports name."""
    named = table(spark, d, "symptoms_texts").filter("patient_id IS NOT NULL")
    places = named.select("patient_id", F.explode(F.regexp_extract_all(F.lower("symptoms"), F.lit("chest|throat"), F.lit(0))).alias("place"))
    flag = lambda x: F.max(F.when(F.col("place") == x, 1)).alias(x)
    return places.groupBy("patient_id").agg(flag("chest"), flag("throat"))


QUERIES, ORACLE = query.queries, query.oracle
