"""The catalogue of preset features."""

from __future__ import annotations

import yaml

from areaweave.functions.features import Expression, Feature


def _f(id_: str, kind: str, scale: float, bounds, num, den, weights=None) -> Feature:
    e = lambda x, w=None: Expression(expression="weighted_sum" if w else "field" if isinstance(x, str) else "sum", fields=[x] if isinstance(x, str) else list(x), weights=w)
    return Feature(id=id_, output_kind=kind, scale=scale, bounds=bounds, numerator=e(num, weights), denominator=e(den))


_P = (0, 100)
_DSS = lambda *names: [f"DSS.{n}_recipients" for n in names]

# The 23 presets.
PRESETS = {
    f.id: f
    for f in (
        _f("businesses_per_1000_residents", "rate", 1000, None, "ABS_CAB.business_count_total", "ERP.population_total"),
        _f("housing_supply_rate", "rate", 1000, None, "ABS_BA.total_dwellings_count", "ERP.population_total"),
        _f("mean_dwelling_approval_value", "scalar", 1000, None, ["ABS_BA.value_new_houses", "ABS_BA.value_new_other_residential_building"], "ABS_BA.total_dwellings_count"),
        _f("mh_admitted_avg_length_of_stay", "ratio", 1, (0, 365), "AIHW_APC.mh_patient_days_count", "AIHW_APC.mh_hospitalisations_count"),
        _f("mh_community_contacts_per_patient", "ratio", 1, (0, 200), "AIHW_CMH.mh_community_contacts_count", "AIHW_CMH.mh_community_patients_count"),
        _f("mh_medicare_services_per_patient", "ratio", 1, (0, 60), "AIHW_MBS.mh_medicare_services_count", "AIHW_MBS.mh_medicare_patients_count"),
        _f("mh_prescriptions_per_patient", "ratio", 1, (0, 60), "AIHW_MHP.mh_prescriptions_count", "AIHW_MHP.mh_patients_count"),
        _f("motor_vehicles_per_dwelling", "ratio", 1, (0, 10), [f"G34.Num_MVs_per_dweling_{n}_MVs" for n in ("0", "1", "2", "3", "4mo")], "G34.Num_MVs_per_dweling_Tot", [0.0, 1.0, 2.0, 3.0, 4.0]),
        _f("pct_age_pension_recipients", "percentage", 1, _P, "DSS.age_pension_recipients", "ERP.population_65_plus"),
        _f("pct_aged_65_plus", "percentage", 1, _P, ["G01.Age_65_74_yr_P", "G01.Age_75_84_yr_P", "G01.Age_85ov_P"], "G01.Tot_P_P"),
        _f("pct_apartment_approvals", "percentage", 1, _P, "ABS_BA.new_other_residential_building_count", "ABS_BA.total_dwellings_count"),
        _f("pct_businesses_non_employing", "percentage", 1, _P, "ABS_CAB.business_count_non_employing", "ABS_CAB.business_count_total"),
        _f("pct_carer_payment_recipients", "percentage", 1, _P, "DSS.carer_payment_recipients", "ERP.population_15_64"),
        _f("pct_commonwealth_rent_assistance_recipients", "percentage", 1, _P, "DSS.commonwealth_rent_assistance_recipients", "ERP.population_total"),
        _f("pct_disability_support_pension_recipients", "percentage", 1, _P, "DSS.disability_support_pension_recipients", "ERP.population_15_64"),
        _f("pct_drive_to_work", "percentage", 1, _P, [f"G62.One_method_{m}_P" for m in ("Car_as_driver", "Car_as_passenger", "Truck", "Motorbike_scootr")], "G62.Tot_P"),
        _f("pct_employed_full_time", "percentage", 1, _P, "G43.lfs_Emplyed_wrked_full_time_P", "G43.lfs_Tot_LF_P"),
        _f("pct_jobseeker_recipients", "percentage", 1, _P, "DSS.jobseeker_payment_recipients", "ERP.population_15_64"),
        _f("pct_one_parent_family", "percentage", 1, _P, "G29.OPF_ChU15_a_Total_F", ["G29.CF_ChU15_a_Total_F", "G29.OPF_ChU15_a_Total_F"]),
        _f("pct_parenting_payment_recipients", "percentage", 1, _P, _DSS("parenting_payment_single", "parenting_payment_partnered"), "ERP.population_15_64"),
        _f("pct_renters", "percentage", 1, _P, "G37.R_Tot_Total", "G37.Total_Total"),
        _f("pct_youth_allowance_recipients", "percentage", 1, _P, _DSS("youth_allowance_other", "youth_allowance_student_and_apprentice"), "ERP.population_15_64"),
        _f(
            "welfare_density_index", "ratio", 1, None,
            _DSS("age_pension", "carer_payment", "commonwealth_rent_assistance", "disability_support_pension", "jobseeker_payment", "parenting_payment_single", "parenting_payment_partnered", "youth_allowance_other", "youth_allowance_student_and_apprentice"),
            "ERP.population_total",
        ),
    )
}


def parse_feature(text: str) -> Feature:
    """A feature from a Markdown file whose front matter is its specification."""
    parts = text.split("---", 2)
    if len(parts) < 3 or parts[0].strip():
        raise ValueError("a feature begins with front matter between --- lines")
    spec = yaml.safe_load(parts[1])
    rules = spec.get("edge_cases") or {}

    def expression(raw: dict | None) -> dict | None:
        if raw is None:
            return None
        return {k: v for k, v in raw.items() if k in ("expression", "fields", "weights")} | ({"fields": [raw["field"]]} if "field" in raw else {})

    # YAML reads the bare word null as nothing: no rule is the rule "null"
    return Feature(
        id=spec["id"],
        label=str(spec.get("label") or ""),
        output_kind=spec.get("output_kind", "ratio"),
        numerator=expression(spec["numerator"]),
        denominator=expression(spec.get("denominator")),
        scale=float(spec.get("scale") or 1),
        bounds=tuple(spec["bounds"]) if spec.get("bounds") else None,
        zero_denominator=rules.get("zero_denominator") or "null",
        out_of_bounds=rules.get("out_of_bounds_behaviour") or "warn",
    )


class FeatureRegistry:
    """Features by id."""

    def __init__(self, features: dict[str, Feature] | None = None):
        self.features = dict(PRESETS if features is None else features)

    def register(self, feature: Feature) -> None:
        self.features[feature.id] = feature

    def get(self, id_: str) -> Feature:
        if id_ not in self.features:
            raise KeyError(f"no feature {id_!r}; there are {sorted(self.features)}")
        return self.features[id_]

    def list_features(self) -> list[Feature]:
        return [self.features[k] for k in sorted(self.features)]

    def __contains__(self, id_: str) -> bool:
        return id_ in self.features
