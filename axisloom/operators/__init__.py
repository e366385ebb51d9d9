from .cells import (
    center_nonzero,
    cells_of,
    column_means_cells,
    frobenius_norm2_cells,
    min_obs_cells,
    nonzero_cells,
    remove_trial_mean,
    trial_mean,
    trials_to_cells,
    trials_to_matrix,
)
from .cells_cov import covariance_cells, products_cells
from .cells_fit import CellModel, canonical_rotation_cells, cross_moments_cells, fit_cells, latent_scores_cells
from .evaluate import (
    accuracy_of,
    confusion,
    explained_variance,
    group_covariances,
    linear_classes,
    model_comparison,
    score_summary,
    singular_value_share,
)
from .kernel import fourier_features, scale_gamma, svm_fit, svm_predict
from .lagged import lagged_covariance
from .model import FactorModel
from .pca import pca_fit, pca_randomized
from .ppca import ppca_fit
from .factor import fa_fit
from .missing import ppca_missing_fit
from .rotate import canonical_rotation
from .rows import (
    center_rows,
    clip_infinite,
    coo_to_rows,
    coo_to_sparse,
    drop_out_of_range,
    fill_missing,
    default_sample_rate,
    first_rows,
    keep_observed_columns,
    latent_scores,
    nan_to_null,
    row_residuals,
    sample_rows,
    variance_normalize,
    zscore_rows,
)
from .stats import (
    array_sum,
    column_means,
    covariance_matrix,
    cross_moments,
    frobenius_norm2,
    l1_error,
    null_aware_stats,
    normalized_scatter,
    variance_cross_term,
)
