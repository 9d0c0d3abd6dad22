"""Column-type registry and value-first detector settings.

Fixed values: detector kinds, parameters, weights, priorities, validators,
header lexicon and patterns, as specified by the reference's registry and
value-first configuration files (natural order kept).
"""

# Column-type registry.
REGISTRY = {'ui': {'min_confidence_accept': 0.7, 'min_confidence_warn': 0.5},
 'types': {'matricule': {'priority': 90,
                         'detectors': [{'kind': 'mask_dominance',
                                        'allow': ['A', '9', '-', '_'],
                                        'min_len': 3,
                                        'max_len': 20,
                                        'coverage_min': 0.6,
                                        'noise_max': 0.15,
                                        'weight': 0.5},
                                       {'kind': 'all_numeric_ratio', 'min_ratio': 0.8, 'weight': 0.3},
                                       {'kind': 'penalize_comma', 'penalty_per_comma': -0.4, 'weight': 0.2}],
                         'validators': [{'kind': 'uniqueness_hint', 'min_uniques_ratio': 0.3},
                                        {'kind': 'reject_constant', 'max_const_ratio': 0.1}]},
           'fullname': {'priority': 80,
                        'detectors': [{'kind': 'contains_comma_ratio', 'min_ratio': 0.45, 'weight': 0.5},
                                      {'kind': 'alpha_token_ratio', 'min_ratio': 0.8, 'weight': 0.3},
                                      {'kind': 'avg_length_range',
                                       'min_len': 10,
                                       'max_len': 60,
                                       'weight': 0.2}],
                        'validators': [{'kind': 'high_entropy', 'min_entropy': 2.5},
                                       {'kind': 'reject_constant', 'max_const_ratio': 0.1}]},
           'nom': {'priority': 70,
                   'detectors': [{'kind': 'high_entropy_alpha',
                                  'min_entropy': 2.5,
                                  'max_const_ratio': 0.25,
                                  'weight': 0.5},
                                 {'kind': 'alpha_only_ratio', 'min_ratio': 0.85, 'weight': 0.3},
                                 {'kind': 'avg_length_range', 'min_len': 3, 'max_len': 40, 'weight': 0.2}],
                   'validators': [{'kind': 'reject_constant', 'max_const_ratio': 0.25}]},
           'prenom': {'priority': 70,
                      'detectors': [{'kind': 'high_entropy_alpha',
                                     'min_entropy': 2.5,
                                     'max_const_ratio': 0.25,
                                     'weight': 0.5},
                                    {'kind': 'alpha_only_ratio', 'min_ratio': 0.85, 'weight': 0.3},
                                    {'kind': 'avg_length_range', 'min_len': 2, 'max_len': 30, 'weight': 0.2}],
                      'validators': [{'kind': 'reject_constant', 'max_const_ratio': 0.25}]},
           'date_paie': {'priority': 85,
                         'detectors': [{'kind': 'date_parse_ratio',
                                        'fr_ca': True,
                                        'excel_1900_1904': True,
                                        'dayfirst': True,
                                        'min_ratio': 0.7,
                                        'weight': 0.7},
                                       {'kind': 'pattern_any',
                                        'patterns': ['^\\d{4}-\\d{2}-\\d{2}$',
                                                     '^\\d{1,2}/\\d{1,2}/\\d{4}$',
                                                     '^\\d{5}$'],
                                        'weight': 0.3}],
                         'validators': []},
           'montant': {'priority': 85,
                       'detectors': [{'kind': 'number_parse_ratio',
                                      'min_ratio': 0.7,
                                      'weight': 0.7},
                                     {'kind': 'pattern_any',
                                      'patterns': ['^-?\\d+[,.]?\\d*$',
                                                   '^\\(\\d+[,.]?\\d*\\)$',
                                                   '^-?\\d{1,3}([ \\u202F]\\d{3})*[,.]\\d{2}$'],
                                      'weight': 0.3}],
                       'validators': []},
           'heures': {'priority': 55,
                      'detectors': [{'kind': 'number_parse_ratio',
                                     'min_ratio': 0.6,
                                     'weight': 0.6},
                                    {'kind': 'number_range_hint',
                                     'min_val': 0,
                                     'max_val': 200,
                                     'expected_ratio': 0.9,
                                     'weight': 0.4}],
                      'validators': []},
           'taux_horaire': {'priority': 55,
                            'detectors': [{'kind': 'number_parse_ratio',
                                           'min_ratio': 0.6,
                                           'weight': 0.6},
                                          {'kind': 'number_range_hint',
                                           'min_val': 10,
                                           'max_val': 150,
                                           'expected_ratio': 0.85,
                                           'weight': 0.4}],
                            'validators': []},
           'part_employeur': {'priority': 75,
                              'detectors': [{'kind': 'number_parse_ratio',
                                             'min_ratio': 0.7,
                                             'weight': 0.7},
                                            {'kind': 'pattern_any',
                                             'patterns': ['^-?\\d+[,.]?\\d*$',
                                                          '^\\(\\d+[,.]?\\d*\\)$',
                                                          '^-?\\d{1,3}([ \\u202F]\\d{3})*[,.]\\d{2}$'],
                                             'weight': 0.3}],
                              'validators': [{'kind': 'reject_constant', 'max_const_ratio': 0.8}]},
           'mnt_cmb': {'priority': 70,
                       'detectors': [{'kind': 'number_parse_ratio',
                                      'min_ratio': 0.6,
                                      'weight': 0.5},
                                     {'kind': 'pattern_any',
                                      'patterns': ['^[A-Z0-9]{2,12}$',
                                                   '^[A-Z]{2,6}\\d{1,6}$',
                                                   '^\\d{2,8}[A-Z]{1,3}$'],
                                      'weight': 0.3},
                                     {'kind': 'avg_length_range',
                                      'min_len': 2,
                                      'max_len': 15,
                                      'weight': 0.2}],
                       'validators': [{'kind': 'reject_constant', 'max_const_ratio': 0.7}]},
           'code_paie': {'priority': 60,
                         'detectors': [{'kind': 'pattern_any',
                                        'patterns': ['^[A-Z]\\d{2,}$',
                                                     '^\\d{2,}[A-Z]{1,2}$',
                                                     '^[A-Z0-9]{2,8}$',
                                                     '^[A-Z]{2,5}$'],
                                        'weight': 0.6},
                                       {'kind': 'low_cardinality_hint',
                                        'max_uniques_ratio': 0.15,
                                        'weight': 0.4}],
                         'validators': []},
           'poste_budgetaire': {'priority': 60,
                                'detectors': [{'kind': 'pattern_any',
                                               'patterns': ['^\\d{2}\\.\\d{2}\\.\\d{2}$',
                                                            '^\\d{2}-\\d{2}-\\d{2}$',
                                                            '^[A-Z]{1}\\d{3,}$',
                                                            '^[\\w-]{3,15}$'],
                                               'weight': 0.7},
                                              {'kind': 'cardinality_range',
                                               'min_uniques_ratio': 0.05,
                                               'max_uniques_ratio': 0.4,
                                               'weight': 0.3}],
                                'validators': []},
           'description_poste': {'priority': 50,
                                 'detectors': [{'kind': 'avg_length_range',
                                                'min_len': 15,
                                                'max_len': 200,
                                                'weight': 0.5},
                                               {'kind': 'entropy_range',
                                                'min_entropy': 2.0,
                                                'max_entropy': 5.0,
                                                'weight': 0.3},
                                               {'kind': 'alpha_ratio', 'min_ratio': 0.7, 'weight': 0.2}],
                                 'validators': []},
           'type_paie': {'priority': 40,
                         'detectors': [{'kind': 'low_cardinality_hint',
                                        'max_uniques_ratio': 0.05,
                                        'weight': 0.6},
                                       {'kind': 'value_in_set_fuzzy',
                                        'values': ['Gains',
                                                   'Déductions',
                                                   'Deductions',
                                                   'Avantages',
                                                   'Benefits'],
                                        'min_match_ratio': 0.4,
                                        'weight': 0.4}],
                         'validators': []},
           'service': {'priority': 40,
                       'detectors': [{'kind': 'medium_entropy_alpha',
                                      'min_entropy': 2.0,
                                      'max_entropy': 4.0,
                                      'weight': 0.6},
                                     {'kind': 'cardinality_range',
                                      'min_uniques_ratio': 0.02,
                                      'max_uniques_ratio': 0.2,
                                      'weight': 0.4}],
                       'validators': []},
           'departement': {'priority': 40,
                           'detectors': [{'kind': 'medium_entropy_alpha',
                                          'min_entropy': 2.0,
                                          'max_entropy': 4.0,
                                          'weight': 0.6},
                                         {'kind': 'cardinality_range',
                                          'min_uniques_ratio': 0.02,
                                          'max_uniques_ratio': 0.2,
                                          'weight': 0.4}],
                           'validators': []},
           'devise': {'priority': 30,
                      'detectors': [{'kind': 'value_in_set',
                                     'values': ['CAD', 'USD', 'EUR', '$', 'C$', 'CA$'],
                                     'weight': 0.8},
                                    {'kind': 'low_cardinality_hint',
                                     'max_uniques_ratio': 0.01,
                                     'weight': 0.2}],
                      'validators': []},
           'emploi': {'priority': 45,
                      'detectors': [{'kind': 'medium_entropy_alpha',
                                     'min_entropy': 2.5,
                                     'max_entropy': 4.5,
                                     'weight': 0.7},
                                    {'kind': 'avg_length_range',
                                     'min_len': 10,
                                     'max_len': 80,
                                     'weight': 0.3}],
                      'validators': []}}}

# Value-first detector configuration.
VALUE_FIRST = {'weights': {'value_patterns': 0.55, 'header': 0.25, 'statistics': 0.15, 'position': 0.05},
 'thresholds': {'accept': 0.7, 'warn': 0.5},
 'headers_lexicon': {'date': ['date',
                              'date paie',
                              'date de paie',
                              'période',
                              'date période',
                              'payment date',
                              'pay date'],
                     'montant': ['montant',
                                 'montant brut',
                                 'montant net',
                                 'déduction',
                                 'amount',
                                 'total',
                                 'salaire',
                                 'salary'],
                     'matricule': ['matricule',
                                   'no employé',
                                   'id employé',
                                   'id',
                                   'numéro',
                                   'employee id',
                                   'emp id',
                                   'numero'],
                     'nom_prenom': ['nom prénom',
                                    'nom, prénom',
                                    'employé',
                                    'salarié',
                                    'fullname',
                                    'name',
                                    'nom et prénom',
                                    'nom prenom'],
                     'code_paie': ['code paie', 'code de paie', 'rubrique', 'pay code', 'code'],
                     'poste_budgetaire': ['poste budgétaire',
                                          'poste budgetaire',
                                          'budget',
                                          'gl',
                                          'compte budgétaire',
                                          'compte budgetaire',
                                          'g/l',
                                          'ledger',
                                          'gl account'],
                     'description_poste': ['description poste',
                                           'libellé poste',
                                           'libelle poste',
                                           'intitulé',
                                           'intitule',
                                           'description',
                                           'label',
                                           'poste description'],
                     'type_paie': ['type de paie',
                                   'catégorie',
                                   'categorie',
                                   'type',
                                   'gains/déductions',
                                   'gains/deductions',
                                   'pay type']},
 'patterns': {'code_paie': '^[A-Za-z]\\w{1,7}([\\-_]\\w{1,6})?$',
              'matricule_digits': '^\\d{3,10}$',
              'poste_budgetaire': ['^\\d{2,5}(-\\d{2,5}){0,3}$',
                                   '^[A-Z]{2,6}\\d{1,6}$',
                                   '^\\d{3}\\s?\\d{2}\\s?\\d{3}$',
                                   '^\\d{4,8}$'],
              'name_has_comma': ',',
              'name_words_min': 2}}
