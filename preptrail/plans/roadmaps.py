"""From requested interviews to stored roadmaps."""

from pyspark.sql import DataFrame

from preptrail.operators.encode import TextEncoder
from preptrail.operators.roadmap import recommend
from preptrail.plans.predictor import Predictor


def interview_roadmaps(
    interviews: DataFrame,
    predictor: Predictor,
    index: DataFrame,
    problems: DataFrame,
    encode: TextEncoder,
) -> DataFrame:
    """Roadmaps of many interviews (interview_id, company, days_until) in one plan."""
    counts = predictor.predict(interviews.select("interview_id", "company", "days_until"))
    return recommend(counts, index, problems, predictor.labels, encode)
