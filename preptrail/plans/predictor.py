"""Fit of the count predictor: features, clusters, curves and labels for every company."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.operators import clustering, curves, distributions, features, registry
from preptrail.session import cut_lineage


@dataclass
class Predictor:
    """Fitted state. Everything that grows with the data stays a DataFrame."""

    shares: DataFrame
    features: DataFrame | None
    scaler: features.Scaler
    selection: clustering.KSelection
    curves: DataFrame
    labels: DataFrame
    members: DataFrame
    max_totals: DataFrame

    def predict(self, requests: DataFrame) -> DataFrame:
        return curves.predict_counts(requests, self.labels, self.curves, self.max_totals)

    def centers(self) -> DataFrame:
        rows = list(enumerate(self.selection.centers))
        return self.curves.sparkSession.createDataFrame(rows, "cluster int, center array<double>")

    def cold_start(self, meta: DataFrame) -> DataFrame:
        """Cluster of companies known from metadata alone."""
        encoded = curves.encode_cold_start(meta, self.scaler.columns, self.features)
        return curves.nearest_centroid(encoded, self.centers(), self.scaler.vector())

    def with_cold_start(self, found: DataFrame) -> "Predictor":
        """Predictor that also knows the looked-up companies; fitted labels are never replaced."""
        fresh = found.join(self.labels.select("company"), "company", "left_anti")
        assigned = self.cold_start(fresh)
        new_members = assigned.select("company", "cluster", self.scaler.vector().alias("vector"))
        labels = self.labels.unionByName(assigned.select("company", "cluster"))
        members = self.members.unionByName(new_members)
        return Predictor(**{**self.__dict__, "labels": cut_lineage(labels), "members": cut_lineage(members)})


def fit(dists: DataFrame, meta: DataFrame | None = None, restarts: int = S.KMEANS_RESTARTS) -> Predictor:
    """Fit on distributions and, if given, company metadata."""
    shares = cut_lineage(distributions.normalized_shares(dists), "shares")
    feats = cut_lineage(features.company_features(meta), "features") if meta is not None else None
    usable, sparse, columns = features.split_clusterable(distributions.volume_pivot(shares), feats)
    usable, sparse = cut_lineage(usable, "usable"), cut_lineage(sparse, "sparse")
    scaler = features.fit_scaler(usable, columns)
    vectors = usable.select("company", scaler.vector().alias("vector"))
    selection = clustering.select_k(vectors, "company", restarts)
    fitted = cut_lineage(curves.fit_curves(shares, selection.labels), "curves")
    assigned = curves.assign_sparse(sparse, shares, fitted)
    labels = cut_lineage(curves.merge_labels(selection.labels, assigned), "clusters")
    members = cut_lineage(labels.join(vectors, "company", "left"), "members")
    totals = cut_lineage(distributions.max_totals(shares), "totals")
    return Predictor(shares, feats, scaler, selection, fitted, labels, members, totals)


def resolve_unknown(predictor: Predictor, requests: DataFrame, registry_rows: DataFrame) -> Predictor:
    """Look requested companies without a label up in the registry and place them in a cluster."""
    unknown = requests.select("company").distinct().join(predictor.labels.select("company"), "company", "left_anti")
    found = registry.lookup_names(unknown, registry_rows)
    return predictor.with_cold_start(found.select(*S.COMPANY_META.fieldNames()).filter(F.col("company").isNotNull()))
