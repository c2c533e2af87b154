"""Cars with images and complaints: joins of modalities, tri-state flags, unions and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.datagen.scaling import denormalise
from quern.models.base import ExpressionModel, ModelSpec
from quern.operators import semantic as sem
from quern.plans.plan import Join, Scan, SemFilter, optimise, run, union_of
from quern.queries.registry import Book
from quern.tables import table

query = Book()

CRASH = "The complaint tells of a crash: {summary}"
FIRE = "The complaint tells of a fire: {summary}"
UNDAMAGED = "The car in the picture has no damage: {image_path}"
DENTED = "The car in the picture is dented: {image_path}"
PUNCTURE_AND_SCRATCH = "The picture shows a punctured tyre and scratches: {image_path}"
ENGINE = "The complaint is about the engine: {summary}"
ELECTRIC = "The complaint is about the electrical system: {summary}"
BOTH = "The picture {image_path} and the complaint {summary} show the same car in trouble"
COMPONENT = "Which component is the complaint about: {summary}"
SAME_PART = "Both complaints are about the same component: {summary:left} / {summary:right}"

COMPONENTS = ["AIR BAGS", "ELECTRICAL SYSTEM", "ENGINE", "FUEL SYSTEM", "POWER TRAIN", "SEAT BELTS", "SERVICE BRAKES", "STEERING", "SUSPENSION", "TIRES", "VISIBILITY"]


def _has(label: str) -> Column:
    return F.array_contains(F.transform(F.split(F.lower("damage_status"), ";"), lambda x: F.trim(x)), label)


GOLD = ExpressionModel(
    {
        CRASH: lambda *_: F.col("crash"),
        FIRE: lambda *_: F.col("fire"),
        UNDAMAGED: lambda *_: F.col("damage_status") == "no_damage",
        DENTED: lambda *_: _has("dented"),
        PUNCTURE_AND_SCRATCH: lambda *_: _has("puncture") & _has("paint_scratches"),
        ENGINE: lambda *_: F.col("component_class") == "ENGINE",
        ELECTRIC: lambda *_: F.col("component_class") == "ELECTRICAL SYSTEM",
        BOTH: lambda *_: F.col("crash") & (F.col("damage_status") != "no_damage"),
        COMPONENT: lambda *_: F.col("component_class"),
        SAME_PART: lambda *_: F.col("component_class_left") == F.col("component_class_right"),
    },
    ModelSpec("gold"),
)
_L = r"regexp_matches(lower(damage_status), '(^|;)\s*{}\s*(;|$)')"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


@query("SELECT DISTINCT car_id FROM complaints WHERE crash AND car_id IS NOT NULL")
def cars_crashed(spark: SparkSession, d: str) -> DataFrame:
    """Cars whose complaint tells of a crash."""
    return sem.sem_filter(_t(spark, d, "complaints"), CRASH, GOLD).filter("car_id IS NOT NULL").select("car_id").distinct()


@query("SELECT DISTINCT c.car_id FROM cars c JOIN complaints t ON c.car_id = t.car_id WHERE c.fuel_type = 'Electric' AND t.fire")
def cars_electric_fire(spark: SparkSession, d: str) -> DataFrame:
    """Electric cars with a fire: the plan asks the model behind the selective join only."""
    reports = SemFilter([Scan(df=_t(spark, d, "complaints"))], FIRE, GOLD, price=5.0)
    plan = Join([reports, Scan(df=_t(spark, d, "cars").filter("fuel_type = 'Electric'").select("car_id", "fuel_type"))], on=[("car_id", "car_id")], selective=True)
    return run(optimise(plan)).select("car_id").distinct()


@query("""SELECT vin FROM cars WHERE transmission = 'Manual' AND vin IS NOT NULL AND car_id IN (SELECT car_id FROM car_images WHERE damage_status = 'no_damage')
    ORDER BY vin LIMIT 10""")
def cars_manual_undamaged(spark: SparkSession, d: str) -> DataFrame:
    """Ten manual cars with a picture without damage."""
    sound = sem.sem_filter(_t(spark, d, "car_images"), UNDAMAGED, GOLD).select("car_id")
    cars = _t(spark, d, "cars").filter("transmission = 'Manual' AND vin IS NOT NULL")
    return cars.join(sound, "car_id", "left_semi").select("vin").orderBy("vin").limit(10)


@query("SELECT round(2026 - avg(c.year), 6) AS average_age FROM cars c JOIN complaints t ON c.car_id = t.car_id WHERE t.component_class = 'ENGINE'")
def cars_engine_age(spark: SparkSession, d: str) -> DataFrame:
    """Mean age over the complaints about engines."""
    engine = sem.sem_filter(_t(spark, d, "complaints"), ENGINE, GOLD).select("car_id")
    return _t(spark, d, "cars").join(engine, "car_id").agg(F.round(2026 - F.avg("year"), 6).alias("average_age"))


@query("SELECT round(2026 - avg(year), 6) AS average_age FROM cars WHERE car_id IN (SELECT car_id FROM complaints WHERE component_class = 'ENGINE')")
def cars_engine_age_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Mean age of the cars with a complaint about the engine, each counted once."""
    engine = sem.sem_filter(_t(spark, d, "complaints"), ENGINE, GOLD).select("car_id")
    return _t(spark, d, "cars").join(engine, "car_id", "left_semi").agg(F.round(2026 - F.avg("year"), 6).alias("average_age"))


@query("""SELECT transmission, count(*) AS "count" FROM cars WHERE transmission = 'Automatic'
    AND car_id IN (SELECT car_id FROM car_images WHERE damage_status <> 'no_damage') AND car_id IN (SELECT car_id FROM complaints WHERE crash) GROUP BY transmission""")
def cars_automatic_damaged(spark: SparkSession, d: str) -> DataFrame:
    """Automatic cars damaged in a picture and by a complaint."""
    images = _t(spark, d, "car_images").filter(F.col("damage_status").isNotNull())
    damaged = sem.sem_if(images, UNDAMAGED, GOLD, "ok").filter("NOT ok").select("car_id")
    crashed = sem.sem_filter(_t(spark, d, "complaints"), CRASH, GOLD).select("car_id")
    cars = _t(spark, d, "cars").filter("transmission = 'Automatic'")
    both = cars.join(damaged, "car_id", "left_semi").join(crashed, "car_id", "left_semi")
    return both.groupBy("transmission").agg(F.count(F.lit(1)).alias("count"))


@query("""WITH flags AS (SELECT c.car_id, max(CASE WHEN i.damage_status IS NULL THEN NULL WHEN i.damage_status = 'no_damage' THEN 0 ELSE 1 END) AS by_image FROM cars c
        LEFT JOIN car_images i ON c.car_id = i.car_id GROUP BY c.car_id),
    words AS (SELECT car_id, max(CASE WHEN fire THEN 1 WHEN NOT fire THEN 0 END) AS by_text FROM complaints GROUP BY car_id)
    SELECT f.car_id, f.by_image, w.by_text FROM flags f LEFT JOIN words w ON f.car_id = w.car_id
    WHERE (f.by_image = 1 OR w.by_text = 1) AND (f.by_image = 0 OR w.by_text = 0)""")
def join_left_tristate(spark: SparkSession, d: str) -> DataFrame:
    """Cars damaged by one modality and sound by the other; a modality that is missing is null.

    Each modality is reduced to one flag a car before it is joined, so no rows multiply.
    """
    ok = sem.sem_if(_t(spark, d, "car_images"), UNDAMAGED, GOLD, "ok").groupBy("car_id").agg(F.max(F.when(F.col("ok"), 0).when(~F.col("ok"), 1)).alias("by_image"))
    fire = sem.sem_if(_t(spark, d, "complaints"), FIRE, GOLD, "f").groupBy("car_id").agg(F.max(F.when(F.col("f"), 1).when(~F.col("f"), 0)).alias("by_text"))
    both = denormalise(_t(spark, d, "cars").select("car_id"), "car_id", ok, fire)
    return both.filter("(by_image = 1 OR by_text = 1) AND (by_image = 0 OR by_text = 0)")


@query(f"""SELECT DISTINCT car_id FROM car_images WHERE {_L.format('dented')} AND car_id IS NOT NULL
    UNION SELECT car_id FROM complaints WHERE component_class = 'ELECTRICAL SYSTEM' AND car_id IS NOT NULL UNION SELECT car_id FROM complaints WHERE fire AND car_id IS NOT NULL""")
def sem_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Cars with a dent, an electrical problem or a fire."""
    complaints = _t(spark, d, "complaints")
    dents = sem.sem_filter(_t(spark, d, "car_images"), DENTED, GOLD)
    return union_of("car_id", dents, sem.sem_filter(complaints, ELECTRIC, GOLD), sem.sem_filter(complaints, FIRE, GOLD)).filter("car_id IS NOT NULL")


@query(f"""SELECT DISTINCT i.image_id, c.vin FROM car_images i JOIN cars c ON c.car_id = i.car_id
    WHERE {_L.format('puncture')} AND {_L.format('paint_scratches')} ORDER BY image_id LIMIT 100""")
def split_label_membership(spark: SparkSession, d: str) -> DataFrame:
    """A hundred pictures with both a puncture and scratches."""
    found = sem.sem_filter(_t(spark, d, "car_images"), PUNCTURE_AND_SCRATCH, GOLD)
    return found.join(_t(spark, d, "cars"), "car_id").select("image_id", "vin").distinct().orderBy("image_id").limit(100)


@query("""SELECT DISTINCT i.car_id FROM car_images i JOIN complaints t ON i.car_id = t.car_id WHERE t.crash AND i.damage_status <> 'no_damage'""")
def sem_filter_multicol(spark: SparkSession, d: str) -> DataFrame:
    """One prompt over a picture and a complaint."""
    pairs = _t(spark, d, "car_images").join(_t(spark, d, "complaints"), "car_id")
    return sem.sem_filter(pairs, BOTH, GOLD).select("car_id").distinct()


@query(f"SELECT component_class AS component, count(DISTINCT complaint_id) AS n FROM complaints WHERE component_class IN ({', '.join(repr(c) for c in COMPONENTS)}) GROUP BY 1")
def sem_classify_components(spark: SparkSession, d: str) -> DataFrame:
    """Complaints by component, in a closed set of classes."""
    judged = sem.sem_classify(_t(spark, d, "complaints"), COMPONENT, COMPONENTS, GOLD, "component")
    return judged.filter("component IS NOT NULL").groupBy("component").agg(F.count_distinct("complaint_id").alias("n"))


@query("""SELECT DISTINCT a.car_id, a.complaint_id AS first, b.complaint_id AS second FROM complaints a JOIN complaints b ON a.car_id = b.car_id AND a.complaint_id <> b.complaint_id
    WHERE a.component_class = b.component_class""")
def sem_join_inner(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of complaints of one car about the same component, blocked by the car."""
    c = _t(spark, d, "complaints").select("car_id", "complaint_id", "summary", "component_class")
    pairs = sem.sem_join(c, c, SAME_PART, GOLD, on=[("car_id", "car_id")], unlike=("complaint_id", "complaint_id"))
    return pairs.select(F.col("car_id_left").alias("car_id"), F.col("complaint_id_left").alias("first"), F.col("complaint_id_right").alias("second")).distinct()


@query("""WITH c AS (SELECT DISTINCT car_id, complaint_id, component_class FROM complaints)
    SELECT a.complaint_id, count(b.complaint_id) AS n_alike FROM c a LEFT JOIN c b ON a.car_id = b.car_id AND a.complaint_id <> b.complaint_id AND a.component_class = b.component_class
    GROUP BY a.complaint_id""")
def sem_join_left_outer(spark: SparkSession, d: str) -> DataFrame:
    """Every complaint with how many others of its car are about the same component, none included."""
    c = _t(spark, d, "complaints").select("car_id", "complaint_id", "component_class").distinct().withColumn("summary", F.lit("")).withColumn("row", F.monotonically_increasing_id())
    c = c.withColumn("row", F.xxhash64("car_id", "complaint_id", "component_class"))
    pairs = sem.sem_join(c, c, SAME_PART, GOLD, on=[("car_id", "car_id")], how="left", unlike=("complaint_id", "complaint_id"), row_id="row")
    return pairs.groupBy(F.col("complaint_id_left").alias("complaint_id")).agg(F.count("complaint_id_right").alias("n_alike"))


@query("""SELECT country, round(avg(mileage), 4) AS mean_mileage, count(*) AS n FROM cars WHERE year >= 2010 AND fuel_type NOT IN ('Diesel') GROUP BY country""")
def group_avg(spark: SparkSession, d: str) -> DataFrame:
    """Mean mileage by country of newer cars that aren't diesels."""
    cars = _t(spark, d, "cars").filter((F.col("year") >= 2010) & ~F.col("fuel_type").isin("Diesel"))
    return cars.groupBy("country").agg(F.round(F.avg("mileage"), 4).alias("mean_mileage"), F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(i.car_id, t.car_id) AS car_id, i.n AS n_images, t.n AS n_complaints FROM (SELECT car_id, count(*) AS n FROM car_images WHERE car_id IS NOT NULL GROUP BY 1) i
    FULL JOIN (SELECT car_id, count(*) AS n FROM complaints WHERE car_id IS NOT NULL GROUP BY 1) t ON i.car_id = t.car_id""")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Cars of either modality with the rows of each."""
    count = lambda name, out: _t(spark, d, name).filter("car_id IS NOT NULL").groupBy("car_id").agg(F.count(F.lit(1)).alias(out))
    return count("car_images", "n_images").join(count("complaints", "n_complaints"), "car_id", "full")


@query("""SELECT i.image_id, i.folder, c.country FROM (SELECT DISTINCT image_id, car_id, split_part(image_path, '/', -1) AS file, split_part(image_path, '/', 2) AS folder FROM car_images) i
    JOIN (SELECT DISTINCT image_id, car_id FROM car_images) m ON i.file = m.image_id || '.jpg' JOIN cars c ON c.car_id = m.car_id""")
def join_mapping_expr_key(spark: SparkSession, d: str) -> DataFrame:
    """Pictures joined through a mapping by the file name at the end of their path."""
    images = _t(spark, d, "car_images")
    parts = F.split("image_path", "/")
    paths = images.select("image_id", F.element_at(parts, -1).alias("file"), F.try_element_at(parts, F.lit(2)).alias("folder")).distinct()
    mapping = images.select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file"), "car_id").distinct()
    return paths.join(mapping, "file").join(_t(spark, d, "cars"), "car_id").select("image_id", "folder", "country").distinct()


QUERIES, ORACLE = query.queries, query.oracle
