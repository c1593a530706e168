"""Values that decide the study results. They are data, not logic."""

# --- fixed values: code patterns -------------------------------------------
TUBERCULOSIS_DX = "^01[0-8]"
METASTATIC_DX = "^19[6-9]"
APPENDICITIS_DX = "^54[0-3]|^47[.]"
# the dots are wildcards, as in the published rule
TB_DRUG_BNF = "^5.1.9"
TB_DRUG_ITEMS_PRIOR = "^ison0[1-9]|^ISON1[012]|^rifa0[12389]|^RIFA1[16]|^rifi0[12]|^rifa05"
TB_DRUG_ITEMS_TREATMENT = (
    "^ison0[1-9]|^ISON1[012]|^rifa0[12389]|^RIFA1[16]|^rifi0[12]|^rifa05"
    "|^pyra0[346]|^etha0[239]|^etha11|^stre01"
)
RIFI_RECODE = "^rifi0[12]|^rifa05"
POSITIVE_TEST_CODES = "^213|^215|^216|^217"
POSITIVE_RESULT = "detected"

# --- fixed values: encounter classes ---------------------------------------
INPATIENT = "1.IP"
ENCOUNTER_CLASSES = {"ip": "1.IP", "ae": "2.AE", "sopc": "3.SO", "gopc": "4.GO"}
PRIMARY = "P"

# --- fixed values: regimen drugs -------------------------------------------
REGIMEN_DRUGS = ["PYRA", "ETHA", "RIFA", "ISON", "STRE", "RIFI"]

# --- fixed values: arms -----------------------------------------------------
BRAND_ARMS = {"BioNTech/Fosun": "BNT162b2", "Sinovac": "CoronaVac"}
UNEXPOSED_ARM = "None"

# --- fixed values: calendar and windows -------------------------------------
CASE_CONTROL_START = "2021-02-23"
STUDY_END = "2022-01-31"
HISTORY_YEARS = [2018, 2019, 2020]
TREATMENT_WINDOW_DAYS = 14
EPISODE_LOOKBACK_DAYS = 180
UTILISATION_DAYS = 365
RISK_WINDOW_DAYS = 30
SPLIT_DAYS = [50, 100, 150]
ADULT_AGE = 18
OLD_AGE = 60

# --- fixed values: matching --------------------------------------------------
MATCH_AGE_GAP = 0
MATCH_DATE_GAP = 1
MATCH_ON = ["sex"]
CONTROLS_PER_CASE = 10
MATCH_SEED = 475

# --- fixed values: comorbidity index weights --------------------------------
INDEX_WEIGHTS = {
    "dx_mi": 1, "dx_chf": 1, "dx_pvd": 1, "dx_cbd": 1, "dx_copd": 1, "dx_dementia": 1,
    "dx_paralysis": 1, "dx_dm_com0": 1, "dx_dm_com1": 2, "dx_crf": 2, "dx_liver_mild": 1,
    "dx_liver_modsev": 3, "dx_ulcers": 1, "dx_ra": 1, "dx_aids": 6, "dx_cancer": 2,
    "dx_cancer_mets": 6,
}
# the milder form counts only where the graver form is absent
INDEX_SUPERSEDED_BY = {"dx_dm_com0": "dx_dm_com1", "dx_liver_mild": "dx_liver_modsev"}

# --- fixed values: covariates ------------------------------------------------
SCORE_DX = ["dx_stroke_embo", "dx_asthma", "dx_infection_resp", "dx_infection_viral", "dx_sle",
            "dx_spa", "dx_psa", "dx_ibd", "dx_ms"]
SCORE_UTILISATION = ["ip", "ae", "sopc", "gopc", "cci"]
SCORE_RX = ["rx_av", "rx_ab", "rx_gc", "rx_immunsupp", "rx_ac", "rx_am", "rx_bb", "rx_ccb",
            "rx_statin", "rx_acei", "rx_arb", "rx_dig"]
TABLE_DX = ["dx_mi", "dx_pvd", "dx_cbd", "dx_copd", "dx_dementia", "dx_paralysis",
            "dx_liver_mild", "dx_liver_modsev", "dx_ulcers", "dx_ra", "dx_cancer", "dx_dm_com0",
            "dx_dm_com1", "dx_chf"]

# --- fixed values: statistics --------------------------------------------------
DAYS_PER_YEAR = 365.25
RATE_SCALE = 10000
TRIM_AT = 0.99
CHI2_95_1DF = 3.841458820694124
Z_95 = 1.959963984540054
